"""A small HTTP front for the latest snapshot and the stop-list. Reads never run a Spark job."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from crestline.operators.snapshot import parse_limit
from crestline.streaming.metrics import Metrics
from crestline.streaming.trending import SnapshotHolder

log = logging.getLogger("crestline")


class StopWords:
    """The editable stop-list; ``table`` gives it to the next snapshot."""

    def __init__(self) -> None:
        self._lock, self._words = threading.Lock(), set()

    def add(self, word: str) -> bool:
        word = word.strip().lower()
        if not word:
            return False
        with self._lock:
            self._words.add(word)
        return True

    def remove(self, word: str) -> bool:
        word = word.strip().lower()
        with self._lock:
            found = word in self._words
            self._words.discard(word)
        return found

    def list(self) -> list[str]:
        with self._lock:
            return sorted(self._words)

    def table(self, spark: SparkSession) -> DataFrame | None:
        words = self.list()
        return spark.createDataFrame([(w,) for w in words], "word string") if words else None


class Service:
    """What the front does, apart from HTTP: (status, body) for a method, path, query and body."""

    def __init__(self, holder: SnapshotHolder, stop: StopWords, metrics: Metrics | None = None):
        self.holder, self.stop, self.metrics = holder, stop, metrics or Metrics()

    def handle(self, method: str, path: str, query: dict[str, str] | None = None, body: bytes = b"") -> tuple[int, object]:
        match method, path:
            case "GET", "/healthz":
                return 200, {"status": "ok"}
            case "GET", "/readyz":
                return (200, {"status": "ready"}) if self.holder.ready else (503, {"status": "not ready"})
            case "GET", "/metrics":
                return 200, self.metrics.text()
            case "GET", "/api/v1/trending":
                try:
                    limit = parse_limit((query or {}).get("limit"))
                except ValueError as e:
                    return 400, {"error": str(e)}
                return 200, {"data": [{"query": q, "count": n} for q, n in self.holder.get(limit)]}
            case "GET", "/api/v1/stoplist":
                return 200, {"data": self.stop.list()}
            case "POST", "/api/v1/stoplist":
                try:
                    word = json.loads(body)["word"]
                except (ValueError, KeyError, TypeError):
                    return 400, {"error": "a JSON object with a word is needed"}
                if not isinstance(word, str) or not self.stop.add(word):
                    return 400, {"error": "the word is blank"}
                return 201, {"word": word.strip().lower()}
            case "DELETE", p if p.startswith("/api/v1/stoplist/"):
                return (200, {"removed": True}) if self.stop.remove(unquote(p.rpartition("/")[2])) else (404, {"error": "no such word"})
        return 404, {"error": "not found"}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """Start answering in threads of their own; shutdown() ends it. Each answer carries its request's id."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            service.metrics.add("trending_http_requests_in_flight", 1)
            try:
                self._respond()
            finally:
                service.metrics.add("trending_http_requests_in_flight", -1)

        def _respond(self) -> None:
            began, url = time.perf_counter(), urlparse(self.path)
            request = self.headers.get("X-Request-ID") or uuid.uuid4().hex
            try:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, out = service.handle(self.command, url.path, {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()}, body)
            except Exception:
                log.exception("request %s failed", request)
                status, out = 500, {"error": "internal error"}
            data = out.encode() if isinstance(out, str) else json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; version=0.0.4" if isinstance(out, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Request-ID", request)
            self.end_headers()
            self.wfile.write(data)
            took = time.perf_counter() - began
            service.metrics.observe("trending_http_request_duration_seconds", took, method=self.command, path=url.path, status=str(status))
            log.info("%s %s %s %.6f %s", self.command, url.path, status, took, request)

        do_GET = do_POST = do_DELETE = _answer  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
