"""Event sources: JSON messages, a Kafka topic, and the user-event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

EVENT = StructType([StructField(n, StringType()) for n in ("event_id", "query", "user_id", "session_id")] + [StructField("timestamp", TimestampType())])
_RAW = StructType([StructField(f.name, StringType()) for f in EVENT] + [StructField("_corrupt", StringType())])
_STRINGS = ("event_id", "query", "user_id", "session_id", "timestamp")
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def decode_json(messages: DataFrame, value: str = "value") -> DataFrame:
    """Decode JSON messages: the columns of EVENT, and ``malformed`` for those that are not an event object.

    Strings must be JSON strings or null, the timestamp RFC 3339; absent strings become empty, an absent timestamp
    null. Malformed rows keep their place with empty fields. Keys are matched as they are written.
    """
    text = F.col(value).cast("string")
    parsed = messages.withColumn("_p", F.from_json(text, _RAW, {"columnNameOfCorruptRecord": "_corrupt"})).withColumn("_v", F.try_parse_json(text))

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")), F.lit("VOID"))

    wrong = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull() | ~F.trim(text).rlike(r"(?s)^\s*\{.*\}\s*\z")
    for name in _STRINGS:
        wrong = wrong | (F.col("_v").isNotNull() & ~kind(name).isin("STRING", "VOID"))
    stamp = F.col("_p.timestamp")
    when = F.when(stamp.rlike(_RFC3339), F.try_to_timestamp(stamp))
    wrong = F.coalesce(wrong | (stamp.isNotNull() & when.isNull()), F.lit(True))
    fields = [F.when(F.col("malformed"), F.lit("")).otherwise(F.coalesce(F.col(f"_p.{n}"), F.lit(""))).alias(n) for n in _STRINGS[:-1]]
    rest = [c for c in messages.columns if c != value]
    return parsed.withColumn("malformed", wrong).withColumn("_when", when).select(*rest, *fields, F.when(~F.col("malformed"), F.col("_when")).alias("timestamp"), "malformed")


def decode_messages(messages: DataFrame) -> DataFrame:
    """Decode rows as a topic gives them (key, value, topic, partition, offset, timestamp, ...): only values count."""
    return decode_json(messages.select("value"))


def encode_messages(events: DataFrame) -> DataFrame:
    """(key, value) as a topic takes them: JSON messages keyed by event_id, both in UTF-8."""
    return events.select(F.col("event_id").cast("binary").alias("key"), encode_json(events).cast("binary").alias("value"))


def kafka_options(brokers: list[str], topic: str, group_id: str | None = None, max_offsets: int | None = None, starting: str = "earliest") -> dict[str, str]:
    """What Spark's Kafka source is told. max_offsets bounds a batch; a lost offset does not stop the stream."""
    if not brokers or not topic:
        raise ValueError("brokers and a topic are needed")
    out = {"kafka.bootstrap.servers": ",".join(brokers), "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "false"}
    if group_id:
        out["groupIdPrefix"] = group_id
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out


def kafka_events(spark: SparkSession, brokers: list[str], topic: str, max_offsets: int | None = None, starting: str = "earliest", group_id: str | None = None) -> DataFrame:
    """A topic as a stream of decoded events; needs Spark's Kafka connector."""
    return decode_messages(spark.readStream.format("kafka").options(**kafka_options(brokers, topic, group_id, max_offsets, starting)).load())


def write_kafka(events: DataFrame, brokers: list[str], topic: str, checkpoint: str):
    """Send a stream of events as messages, or a table of events at once; needs Spark's Kafka connector."""
    rows, options = encode_messages(events), {"kafka.bootstrap.servers": ",".join(brokers), "topic": topic}
    if not events.isStreaming:
        return rows.write.format("kafka").options(**options).save()
    return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()


def encode_json(events: DataFrame) -> Column:
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct("event_id", "query", "user_id", "session_id", stamp.alias("timestamp")))


def user_events(table: DataFrame, query: str = "event_type", first_us: int | None = None, last_us: int | None = None) -> DataFrame:
    """The user-event table in the shape of EVENT: each tenth user is a guest, known by session only.

    query: event_type, or k for the number in the properties. Rows before first_us or after last_us are not read: the
    comparison is made on the column as it is stored, so that it reaches the scan.
    """
    kind = table.schema["ts"].dataType.simpleString()
    for us, op in ((first_us, ">="), (last_us, "<=")):
        if us is not None:
            bound = F.timestamp_micros(F.lit(us)).cast(kind)
            table = table.where(F.col("ts") >= bound if op == ">=" else F.col("ts") <= bound)
    key = F.col("event_type") if query == "event_type" else F.get_json_object("props", f"$.{query}")
    guest = F.col("user_id") % 10 == 0
    return table.select(
        F.col("event_id").cast("string").alias("event_id"),
        key.alias("query"),
        F.when(guest, "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(guest, F.concat(F.lit("s"), F.col("user_id").cast("string"))).otherwise("").alias("session_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )
