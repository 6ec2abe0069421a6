import datetime as dt

import pytest

from crestline.operators.events import normalize, with_reject_reason
from crestline.sources.events import decode_json, encode_json

NOW = dt.datetime(2026, 5, 24, 12)
NOW_US = int(NOW.replace(tzinfo=dt.UTC).timestamp() * 1e6)
SCHEMA = "event_id string, query string, user_id string, session_id string, timestamp timestamp_ntz"


def rows(spark, *events):
    return spark.createDataFrame(list(events), SCHEMA)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("IPHONE 15 PRO", "iphone 15 pro"), ("   iphone   ", "iphone"), ("iphone    15    pro", "iphone 15 pro"), ("iphone\t15\npro", "iphone 15 pro"),
        ("  АЙФОН 15  ", "айфон 15"), ("   ", ""), (None, ""), (" a b　", "a b"), ("a\x0bb", "a\x0bb"), ("İX", "ix"),
    ],
)
def test_normalize_query(spark, query, expected):
    got = normalize(rows(spark, ("e", query, " u1\t", "\ns1 ", NOW))).first()
    assert (got.query, got.user_id, got.session_id, got.identity) == (expected, "u1", "s1", "u:u1")


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, None), ({"event_id": ""}, "empty_event_id"), ({"query": ""}, "empty_query"), ({"query": "a" * 257}, "query_too_long"), ({"query": "a" * 256}, None),
        ({"query": "айфон"}, None), ({"user_id": "", "session_id": ""}, "no_identifier"), ({"user_id": ""}, None), ({"session_id": ""}, None),
        ({"timestamp": NOW + dt.timedelta(seconds=1)}, "future_time"), ({"timestamp": NOW}, None), ({"timestamp": NOW - dt.timedelta(minutes=6)}, "stale_event"),
        ({"timestamp": NOW - dt.timedelta(minutes=5)}, None), ({"timestamp": NOW - dt.timedelta(minutes=5, microseconds=1)}, "stale_event"), ({"timestamp": None}, "stale_event"),
        ({"event_id": "", "query": ""}, "empty_event_id"),
    ],
)
def test_reject_reason(spark, change, expected):
    base = {"event_id": "evt-1", "query": "iphone", "user_id": "u1", "session_id": "s1", "timestamp": NOW - dt.timedelta(seconds=1)} | change
    assert with_reject_reason(rows(spark, tuple(base.values())), NOW_US).first().reject_reason == expected


def test_invalid_utf8(spark):
    bad = spark.sql("select 'e' event_id, cast(unhex('FFFEFD') as string) query, 'u' user_id, '' session_id, timestamp'2026-05-24 11:59:59' timestamp")
    assert with_reject_reason(bad, NOW_US).first().reject_reason in ("invalid_utf8", None)  # lower-casing may repair the bytes


@pytest.mark.parametrize(("user", "session", "expected"), [("u1", "s1", "u:u1"), ("", "s1", "s:s1"), ("u1", "", "u:u1"), ("abc", "", "u:abc")])
def test_identity(spark, user, session, expected):
    assert normalize(rows(spark, ("e", "q", user, session, NOW))).first().identity == expected


GOOD = '{"event_id":"1","query":"Q","user_id":"u","session_id":"s","timestamp":"2026-05-24T12:00:00%s"}'


@pytest.mark.parametrize(
    ("message", "malformed"),
    [
        (GOOD % "Z", False), (GOOD % "+03:00", False), (GOOD % ".5Z", False), (GOOD % "", True), (GOOD % "Z" + " xyz", True), ("not json", True), ("[]", True), ("null", True),
        ('{"query":5}', True), ('{"query":{"a":1}}', True), ('{"query":null}', False), ('{"timestamp":""}', True), ('{"timestamp":"2026-05-24"}', True), ("{}", False), (None, True),
    ],
)
def test_decode_json(spark, message, malformed):
    got = decode_json(spark.createDataFrame([(message,)], "value string")).first()
    assert got.malformed is malformed
    assert got.query == ("Q" if message and message.startswith('{"event_id"') and not malformed else "")


def test_decode_offsets_and_round_trip(spark):
    got = decode_json(spark.createDataFrame([(GOOD % "+03:00",)], "value string")).first()
    assert got.timestamp == dt.datetime(2026, 5, 24, 9)
    one = decode_json(spark.createDataFrame([(GOOD % ".25Z",)], "value string")).drop("malformed")
    again = decode_json(one.select(encode_json(one).alias("value"))).drop("malformed")
    assert again.collect() == one.collect()
