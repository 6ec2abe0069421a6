"""Secrets in whole texts: known forms, and random strings that a public tokenizer needs many tokens for.

A merge vocabulary spells words in few tokens and random strings in many. Runs of token characters with a low ratio of
characters to tokens are reported, once digests, UUIDs, addresses, numbers, and paths and identifiers made of words that
the vocabulary knows are set aside.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crestline.llm.common import env_path
from crestline.llm.spans import Span, ordered, scan_texts

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = env_path("CRESTLINE_TIKTOKEN", "/opt/tokenizers/byte_bpe_50k.tiktoken")
MAX_VOCABULARY_BYTES = 16 << 20
MIN_RANDOM = 20
MAX_CHARS_PER_TOKEN = 2.0
LETTERS_MARGIN = 0.2

_ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST_LABEL = re.compile(r"(?i)(?:md5|sha-?(?:1|224|256|384|512)|digest|checksum|integrity)[\"']?\s*[:=-]\s*[\"']?")
_DIGEST_PREFIX = re.compile(r"(?i)(?:md5|sha-?(?:1|224|256|384|512))[_=-]")
#: scheme, user information, then host and path, which name a place; what follows ? or # is no part of the name
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^\s/?#@<>\"']*@)?([^\s?#<>\"']*)")
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[0-9]{1,4}|[/_=+-])+\Z")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEX_ONLY = re.compile(r"[0-9A-Fa-f]+\Z")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the three known forms; those too short are dropped."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [Span("assign", m.start(), m.end(), True, m.group()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        out += [Span("access", m.start(), m.end(), True, m.group()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [Span("hex", m.start(), m.end(), True, m.group()) for m in _HEX.finditer(text)]
    return out


def _backed(run: str, count: Callable[[str], int], most: float) -> bool:
    """An identifier at least half of which are words that the vocabulary spells in few tokens."""
    words = [x for x in _PIECE.findall(run) if len(x) > 2]
    return 2 * sum(map(len, words)) >= len(run) and bool(_IDENTIFIER.match(run)) and 2 * sum(len(x) for x in words if len(x) > most * count(x)) >= len(run)


def _path(run: str, count: Callable[[str], int], most: float) -> bool:
    """More than two slashes, and most of the segments are numbers or identifiers, some of them words; base64 holds slashes too."""
    segments = [x for x in run.split("/") if x]
    if run.count("/") <= 2 or 2 * sum(bool(_IDENTIFIER.match(x)) for x in segments) <= len(segments):
        return False
    return any(_backed(x, count, most) for x in segments) and 2 * sum(x.isdigit() or _backed(x, count, most) or len(x) < 4 for x in segments) > len(segments)


def _known(run: str, labelled: bool, count: Callable[[str], int], most: float) -> bool:
    """Digests, numbers, paths and identifiers made of words, which are no secrets however random they look."""
    if labelled or not any(map(str.isalpha, run)) or _UUID.fullmatch(run) or (_HEX_ONLY.match(run) and len(run) in _DIGEST_LENGTHS) or _DIGEST_PREFIX.match(run):
        return True
    return _path(run, count, most) or _backed(run, count, most)


def random_spans(text: str, count: Callable[[str], int], taken: list[Span], most: float, least: int) -> list[Span]:
    """Runs of token characters with at most ``most`` characters a token that overlap none of ``taken``, in one sweep.

    A run of letters only must lie LETTERS_MARGIN below, as unknown words do not. Runs inside the host or path of an
    address and those right behind a digest's label are set aside, however long the address or the gap is.
    """
    runs = [m.span() for m in _RUN.finditer(text) if m.end() - m.start() >= least]
    if not runs:
        return []
    labels = {m.end() for m in _DIGEST_LABEL.finditer(text)}
    places = [m.span(1) for m in _ADDRESS.finditer(text)] if "://" in text else []
    aside, out, at, far = sorted([(x.start, x.end) for x in taken] + places), [], 0, -1
    for start, end in runs:
        while at < len(aside) and aside[at][0] < end:
            far, at = max(far, aside[at][1]), at + 1
        run = text[start:end]
        if far > start or len(run) > (most - LETTERS_MARGIN * run.isalpha()) * count(run) or _known(run, start in labels, count, most):
            continue
        out.append(Span("random", start, end, False, run))
    return out


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """The rank file, read on the driver so that executors need no copy of it. Its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


_COUNTERS: dict[int, Callable[[str], int]] = {}


def token_counter(data: bytes) -> Callable[[str], int]:
    """Tokens of a string without white space; long strings are cut into pieces of 256 characters, all of them counted."""
    key = hash(data)
    if key not in _COUNTERS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        coder = tiktoken.Encoding("ratio", pat_str=r"\S{1,256}|\s+", mergeable_ranks=ranks, special_tokens={})
        _COUNTERS.clear()
        _COUNTERS[key] = lambda text: len(coder.encode_ordinary(text))
    return _COUNTERS[key]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = VOCABULARY, max_chars_per_token: float = MAX_CHARS_PER_TOKEN, min_random: int = MIN_RANDOM) -> DataFrame:
    """(doc_id, spans) for every row: kind, start, end, base, text; code points of the whole text.

    Null and empty texts have no spans; repeated rows and null ids stay. Other columns are not read. Time and memory
    follow a text's length, whatever it holds. The vocabulary is broadcast: its size is fixed and checked.
    """
    return scan_texts(docs, _scanner(docs.sparkSession, vocabulary_path, max_chars_per_token, min_random), id_col, text_col)


def _scanner(spark: SparkSession, path: str, most: float, least: int) -> Callable[[], Callable[[str], list[Span]]]:
    ranks = spark.sparkContext.broadcast(vocabulary(spark, path))

    def scanner() -> Callable[[str], list[Span]]:
        def find(text: str) -> list[Span]:
            base = base_spans(text)
            return ordered(base + random_spans(text, lambda x: token_counter(ranks.value)(x), base, most, least), KINDS)

        return find

    return scanner


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, pos = [], 0
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if x.start >= pos:
            out += [text[pos : x.start], f"[{x.kind}]"]
        pos = max(pos, x.end)
    return "".join([*out, text[pos:]])


def redact_secrets(docs: DataFrame, vocabulary_path: str = VOCABULARY, max_chars_per_token: float = MAX_CHARS_PER_TOKEN, min_random: int = MIN_RANDOM) -> DataFrame:
    """The rows of docs, all columns, with every secret in text replaced; n_chars, if there, is the new length.

    Null and empty texts stay as they are, and so do repeated rows, null ids and columns of any other name. An empty
    table stays empty.
    """
    scanner, at = _scanner(docs.sparkSession, vocabulary_path, max_chars_per_token, min_random), docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), {}
            for i, text in enumerate(texts):
                if spans := find(text or ""):
                    found[i] = redact(text, spans)
            if found:
                columns = list(batch.columns)
                columns[at] = pa.array([found.get(i, x) for i, x in enumerate(texts)], columns[at].type)
                if length is not None:
                    columns[length] = pa.array([len(found[i]) if i in found else x for i, x in enumerate(columns[length].to_pylist())], columns[length].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(scan, docs.schema)
