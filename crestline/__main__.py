"""python -m crestline serve|topic|generate: the service on a Kafka topic, the topic itself, or synthetic events as files."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from crestline.config import Config
from crestline.logs import configure
from crestline.sources.events import encode_json
from crestline.sources.generator import generate_events
from crestline.sources.storage import shared_dir
from crestline.sources.topics import ensure_topic
from crestline.streaming.live import run


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="crestline")
    commands = parser.add_subparsers(dest="command", required=True)
    live = commands.add_parser("serve", help="rank the configured topic; parameters come from the environment")
    live.add_argument("--path", help="folder for panes and state; the shared folder by default")
    commands.add_parser("topic", help="make the configured topic if it is not there")
    made = commands.add_parser("generate", help="write synthetic events as JSON lines")
    made.add_argument("out")
    for name, default in (("rps", 1000), ("queries", 5000), ("users", 50_000), ("bots", 20), ("duration", 30), ("seed", 0)):
        made.add_argument(f"--{name}", type=int, default=default)
    made.add_argument("--bot-share", type=float, default=0.0)
    made.add_argument("--bot-query", default="fake-trend")
    given = parser.parse_args(args)
    cfg = Config.from_env()
    configure(cfg.log_level, cfg.log_format)
    spark = SparkSession.builder.appName("crestline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "topic":
        ensure_topic(spark, list(cfg.brokers), cfg.topic)
        return
    if given.command == "serve":
        ensure_topic(spark, list(cfg.brokers), cfg.topic)
        run(spark, cfg, given.path or f"{shared_dir(spark)}/live")
        return
    n, start = given.rps * given.duration, time.time_ns() // 1000 - given.duration * 1_000_000
    events = generate_events(spark, n, start, given.rps, given.queries, given.users, given.bot_share, given.bot_query, given.bots, given.seed)
    events.select(encode_json(events).alias("value")).write.text(given.out)


if __name__ == "__main__":
    main()
