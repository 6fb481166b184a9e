import gzip
import json
import logging
import math
import random
import threading
import time
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from logmill.config import Config
from logmill.functions.timeparse import format_ms, parse_ts, parse_us, to_us
from logmill.jsonlog import JsonFormatter
from logmill.operators import auth, rollup, stats
from logmill.operators.aggregate import AggregateQuery, aggregate, counts
from logmill.operators.cursor import Cursor
from logmill.operators.filters import LogFilters, escape_like
from logmill.operators.logs import page
from logmill.operators.retention import Janitor, retain, survivors
from logmill.schema import RequestError
from logmill.service import Service
from logmill.session import within
from logmill.sources import generate, sequence
from logmill.sources.ingest import compact, ingest, ingest_folder, read_bodies, read_logs, write
from logmill.streaming.ingest import drain, ingest_stream, stalled, write_batch

NOW = datetime(2026, 7, 20, 14, 32, 1, tzinfo=UTC)
LATER = datetime(2031, 1, 1, tzinfo=UTC)


def entry(**change):
    return {"timestamp": "2026-07-20T14:30:59.5Z", "level": "warn", "service": "billing", "message": "invoice 77 is late", "attributes": {"customer": "k-9", "attempt": 2, "final": True}} | change


def body(*entries):
    return json.dumps({"logs": list(entries)}).replace('"1e999"', "1e999")  # a number that no double holds


TIMES = {
    "2026-07-20T14:32:01.123Z": 1784557921123000, "2026-07-20 14:32": 1784557920000000, "2026-07-20t14:32:01z": 1784557921000000, "2026-07-20T14:32:01.1234569Z": 1784557921123456,
    "2026-07-20T16:32:01+02:00": 1784557921000000, "2026-07-20T12:02:01-0230": 1784557921000000, "1969-12-31T23:59:59.9Z": -100000, "2024-02-29T00:00:00Z": 1709164800000000,
    "2026-07-20T14:32:01+19:00": 1784489521000000, "2026-07-20T14:32:01-23:59": 1784644261000000, "2026-07-20T14:32:01+02:99": None, "2026-07-20T14:32:01+24:00": None, "2026-07-20T14:32:01Z\n": None, "2026-07-20T14:32:01.Z": None,
    "0001-01-01T00:00:00Z": -62135596800000000, "2026-07-20T14:32+0130": 1784552520000000, "9999-12-31T23:59:59.999999-01:00": 253402304399999999,
    "2023-02-29T00:00:00Z": None, "2026-07-20": None, "2026-07-20T25:00:00Z": None, "2026-13-01T00:00:00Z": None, "": None, "now": None, "2026-7-2T1:2:3Z": None,
}


def test_instants(spark):
    assert {t: parse_us(t) for t in TIMES} == TIMES
    rows = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", to_us(parse_ts(F.col("t"))).alias("us")).collect()
    assert {r.t: r.us for r in rows} == TIMES
    assert spark.range(1).select(format_ms(F.timestamp_micros(F.lit(-1)))).head()[0] == "1969-12-31T23:59:59.999Z"


BAD = [
    (7, "entry must be a JSON object"), ([], "entry must be a JSON object"), (None, "entry must be a JSON object"),
    (entry(timestamp=None), "timestamp is required"), (entry(timestamp=5), "timestamp must be an ISO 8601 string"), (entry(timestamp="x"), 'invalid timestamp: "x" is not a valid ISO 8601 instant'),
    (entry(timestamp="2026-07-20T14:37:01.001Z"), "timestamp is more than five minutes in the future"), (entry(level=None), "level is required"), (entry(level=1), "level must be one of: debug, info, warn, error"),
    (entry(level="ERROR"), "invalid level: 'ERROR'"), (entry(service=42), "service must be a non-empty string"), (entry(service="s" * 256), "service exceeds 255 characters"),
    (entry(message=""), "message must be a non-empty string"), (entry(message="m" * 65537), "message exceeds 65536 characters"), (entry(attributes=[1]), "attributes must be a flat object"),
    (entry(attributes={f"k{i}": 1 for i in range(129)}), "attributes exceeds 128 keys"), (entry(attributes={"": 1}), "attribute keys must be non-empty"),
    (entry(attributes={"k" * 256: 1}), f"attribute key '{'k' * 32}...' exceeds 255 characters"), (entry(attributes={"k": "v" * 8193}), "attribute 'k' exceeds 8192 characters"),
    (entry(attributes={"k": "1e999"}), "attribute 'k' must be a finite number"), (entry(attributes={"k": [1]}), "attribute 'k' must be a string, number, or boolean (nested objects and arrays are not allowed)"),
    (entry(message=None), "message is required"), (entry(message=7), "message must be a non-empty string"), (entry(service=None), "service is required"), (entry(service=""), "service must be a non-empty string"), (entry(attributes="x"), "attributes must be a flat object"),
    (entry(attributes={"k": None}), "attribute 'k' must be a string, number, or boolean (nested objects and arrays are not allowed)"), (entry(level="x", service=""), "invalid level: 'x'"),
]


def test_reasons_and_round_trip(spark, tmp_path):
    path = str(tmp_path / "logs")
    good = [entry(), entry(attributes=None), entry(timestamp="2026-07-20T14:37:01Z"), entry(timestamp="1999-01-01T00:00Z", attributes={"a.b": 3.0, "q'": 1e2, "s": "3"})]
    status, reply = ingest(spark, body(*(e for e, _ in BAD), *good), path, NOW)
    assert status == 200 and reply == {"accepted": 4, "rejected": [{"index": i, "reason": r} for i, (_, r) in enumerate(BAD)]}
    got = page(read_logs(spark, path), {})
    assert len(got["logs"]) == 4 and got["next_cursor"] is None
    assert got["logs"][2]["attributes"] == {"customer": "k-9", "attempt": 2, "final": True}
    assert len(page(read_logs(spark, path), {"attr.a.b": "3", "attr.q'": "100"})["logs"]) == 1
    assert ingest(spark, body(entry(level="x")), path, NOW)[0] == 400
    for wrong in ("", "{", "[]", "{}", '{"logs":[]}'):
        with pytest.raises(RequestError):
            ingest(spark, wrong, path, NOW)
    assert retain(spark, path, 30, NOW)["dropped"] == ["1999-01-01"]
    plan = LogFilters.parse({"since": "2026-07-20T00:00:00Z"}).apply(read_logs(spark, path))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_pages_hold_each_row_once(spark, tmp_path):
    path = str(tmp_path / "logs")
    ingest(spark, body(*(entry(attributes={"seq": i}) for i in range(25))), path, NOW)
    seen, params = [], {"limit": "10"}
    while True:
        got = page(read_logs(spark, path), params)
        seen += [r["id"] for r in got["logs"]]
        if not got["next_cursor"]:
            break
        params["cursor"] = got["next_cursor"]
    assert len(seen) == len(set(seen)) == 25


@pytest.mark.parametrize("params", [{"service": ""}, {"level": "x"}, {"since": "x"}, {"q": "a" * 1025}, {"attr.": "1"}, {"since": "2026-01-02T00:00Z", "until": "2026-01-01T00:00Z"}, [(f"attr.k{i}", "1") for i in range(17)]])
def test_bad_filters(params):
    with pytest.raises(RequestError):
        LogFilters.parse(params)


def test_parameters():
    assert LogFilters.parse({"q": "", "other": "1"}) == LogFilters()
    assert [escape_like(x) for x in ("100%", "a_b", "back\\slash")] == ["100\\%", "a\\_b", "back\\\\slash"]
    c = Cursor(-5, 2**63 - 1)
    assert Cursor.decode(c.encode()) == c
    for wrong in ("!", "e30", "a" * 513, Cursor(1, 2**63).encode()):
        with pytest.raises(RequestError):
            Cursor.decode(wrong)
    for wrong in ({}, {"since": "2026-01-01T00:00Z", "until": "2026-01-02T00:00Z", "bucket": "2m"}, {"since": "2000-01-01T00:00Z", "until": "2026-01-02T00:00Z", "bucket": "1m"}):
        with pytest.raises(RequestError):
            AggregateQuery.parse(wrong)


def test_aggregate_counts(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = [entry(timestamp=f"2026-07-20T14:0{m}:{s:02d}Z", level="info" if s % 2 else "error") for m, n in enumerate((5, 3, 2)) for s in range(n)]
    ingest(spark, body(*rows), path, NOW)
    params = {"since": "2026-07-20T14:00:00Z", "until": "2026-07-20T15:00:00Z", "bucket": "1m"}
    got = [tuple(r) for r in aggregate(read_logs(spark, path), params).collect()]
    assert got == [("2026-07-20T14:00:00Z", None, 5), ("2026-07-20T14:01:00Z", None, 3), ("2026-07-20T14:02:00Z", None, 2)]
    assert [r["group"] for r in aggregate(read_logs(spark, path), params | {"bucket": "1h", "group_by": "level"}).collect()] == ["info", "error"]


def test_ids_are_unique_over_batches(spark, tmp_path):
    path = str(tmp_path / "logs")
    for _ in range(3):
        ingest(spark, body(entry(), entry(level="x"), entry()), path, NOW)
    ids = [r.id for r in read_logs(spark, path).select("id").collect()]
    assert sorted(ids) == [1, 3, 4, 6, 7, 9]
    assert sequence.reserve(spark, path, 5) == 10 and sequence.reserve(spark, path, 1) == 15
    assert sequence.once(spark, path, "b", 4, NOW) == sequence.once(spark, path, "b", 9, LATER) == (16, NOW)


def test_a_batch_written_again_is_the_same(spark, tmp_path):
    """Ids, clock and files of a replay are those of the first attempt, refused bodies and rejections included."""
    (tmp_path / "in").mkdir()
    texts = [body(entry(), entry(level="x")), "{", body(entry(timestamp="2026-07-20T14:36:00Z"), entry(timestamp="2030-01-01T00:00Z")), " ", body(entry())]
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.json").write_text(text)
    (tmp_path / "in" / "9.json.gz").write_bytes(gzip.compress(body(entry(service="zipped")).encode()))
    path, bad = str(tmp_path / "logs"), str(tmp_path / "bad")
    bodies = read_bodies(spark, str(tmp_path / "in"))
    seen = []
    for clock in (NOW, LATER):  # a later clock would accept what the first rejected
        write(spark, bodies, path, bad, "one", clock)
        rows = spark.read.parquet(bad).collect()
        seen.append((sorted(map(tuple, read_logs(spark, path).collect())), sorted(map(str, rows))))
    assert seen[0] == seen[1] and [r[0] for r in seen[0][0]] == [1, 3, 5, 6]
    got = sorted((r.path[-6:], r["index"], r.reason, r.body) for r in rows)
    assert [g[:2] for g in got if g[1] is not None] == [("0.json", 1), ("2.json", 1)]
    assert [g[2:] for g in got if g[1] is None] == [("request body is not valid JSON", "{"), ("request body is empty", " ")]
    done = ingest_folder(spark, str(tmp_path / "in"), path, bad, NOW)
    assert done["rejected"] == 4 and read_logs(spark, path).select("id").distinct().count() == 8
    assert compact(spark, path, "2026-07-20") == 2 and read_logs(spark, path).count() == 8


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(body(entry(), entry(level="x"), entry(timestamp="1999-01-01T00:00Z")))
    (tmp_path / "in" / "refused.json").write_text("[]")
    where = [str(tmp_path / x) for x in ("in", "logs", "bad", "check")]
    for _ in range(2):  # a file a batch; a second run has nothing new
        ingest_stream(spark, *where, files=1).awaitTermination(120)
    logs = read_logs(spark, where[1])
    assert logs.count() == logs.select("id").distinct().count() == 6
    rejected = spark.read.parquet(where[2])
    assert rejected.count() == 4 and rejected.where("index is null").select("reason", "body").collect() == [("body must be an object with a logs array", "[]")]
    assert retain(spark, where[1], 30, NOW)["dropped"] == ["1999-01-01"] and read_logs(spark, where[1]).count() == 3
    files = len(list((tmp_path / "logs").rglob("*.parquet")))
    write_batch(spark.createDataFrame([("a", body(entry()))], "path string, value string"), 7, where[1], where[2], now=NOW)
    write_batch(spark.createDataFrame([("a", body(entry()))], "path string, value string"), 7, where[1], where[2], now=NOW)
    assert read_logs(spark, where[1]).count() == 4 and len(list((tmp_path / "logs").rglob("*.parquet"))) == files + 1


def test_a_running_stream_drains(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(body(entry()))
    where = [str(tmp_path / x) for x in ("in", "logs", "bad", "check")]
    query = ingest_stream(spark, *where, bytes_=8 << 20, every="1 second", available_now=False)
    query.processAllAvailable()
    assert not stalled(query, 60)
    assert drain(query, 30) and not query.isActive and read_logs(spark, where[1]).count() == 1


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Logs of three services and levels with ties, mixed attributes and characters that patterns know."""
    path = str(tmp_path_factory.mktemp("table") / "logs")
    rows = [
        entry(timestamp="2026-07-20T10:00:00Z", level="error", service="mailer", message="Queue REFUSED the letter", attributes={"zone": "north", "tries": 5, "of": "acme"}),
        entry(timestamp="2026-07-20T10:00:01Z", level="info", service="mailer", message="letter sent", attributes={"zone": "south", "tries": "5", "of": "acme"}),
        entry(timestamp="2026-07-20T10:00:02Z", level="warn", service="search", message="index refused, 50% full_up", attributes={"zone": "north", "tries": 1, "of": "zeta", "a.b'c": True}),
    ]
    ingest(spark, body(*rows), path, NOW)
    return read_logs(spark, path)


@pytest.mark.parametrize("params, services", [
    ({}, ["search", "mailer", "mailer"]), ({"service": "mailer"}, ["mailer", "mailer"]), ({"service": "none"}, []), ({"level": "warn"}, ["search"]), ({"attr.tries": "5"}, ["mailer", "mailer"]),
    ([("attr.zone", "north"), ("attr.of", "acme")], ["mailer"]), ([("attr.zone", "north"), ("attr.zone", "south")], []), ({"attr.a.b'c": "true"}, ["search"]), ({"attr.none": "1"}, []), ({"attr.x') OR 1=1 --": "1"}, []),
    ({"q": "refused"}, ["search", "mailer"]), ({"q": "%"}, ["search"]), ({"q": "_"}, ["search"]), ({"q": "l_tter"}, []), ({"q": "\\"}, []),
    ({"since": "2026-07-20T10:00:01Z"}, ["search", "mailer"]), ({"until": "2026-07-20T10:00:01Z"}, ["mailer"]), ({"since": "2026-07-20T10:00:01Z", "until": "2026-07-20T10:00:01Z"}, []), ({"until": "0001-01-01T00:00:00Z"}, []),
    ({"service": "mailer", "level": "error", "attr.tries": "5", "q": "queue", "since": "2026-07-20T10:00:00Z", "until": "2026-07-20T10:00:01Z"}, ["mailer"]),
])
def test_filters_of_pages(table, params, services):
    got = page(table, params)
    assert [r["service"] for r in got["logs"]] == services and got["next_cursor"] is None


def test_pages_descend_and_know_their_limits(table):
    times = [r["timestamp"] for r in page(table, {})["logs"]]
    assert times == sorted(times, reverse=True) and times[0] == "2026-07-20T10:00:02.000Z"
    for limit in ("0", "1001", "-1", "x", "1.5", "", "\u0661"):
        with pytest.raises(RequestError):
            page(table, {"limit": limit})
    assert len(page(table, {"limit": "1"})["logs"]) == 1 and page(table, {"limit": "3", "cursor": ""})["next_cursor"] is None


def test_aggregates_by_group(table):
    params = {"since": "2026-07-20T00:00:00Z", "until": "2026-07-21T00:00:00Z", "bucket": "1d"}
    assert [tuple(r) for r in aggregate(table, params | {"group_by": "service"}).collect()] == [("2026-07-20T00:00:00Z", "mailer", 2), ("2026-07-20T00:00:00Z", "search", 1)]
    assert [r["group"] for r in aggregate(table, params | {"group_by": "level"}).collect()] == ["info", "warn", "error"]
    assert aggregate(table, params | {"since": params["until"]}).collect() == []
    until = datetime(2026, 7, 20, 10, 0, tzinfo=UTC)
    assert sorted(map(tuple, rollup.counts(rollup.closed(table, until), table, until, "1h", "level").collect()), key=str) == sorted(map(tuple, counts(table, "1h", "level").collect()), key=str)


def test_survivors_read_their_days_only(table):
    assert survivors(table, 1, NOW).count() == 3 and survivors(table, 0, LATER).count() == 0
    assert "PartitionFilters: [isnotnull(day" in survivors(table, 1, NOW)._jdf.queryExecution().toString()


def test_janitor():
    calls, gate, busy = [], threading.Event(), threading.Event()

    def sweep():
        calls.append(1)
        if len(calls) == 2:
            busy.set()
            gate.wait(10)
        return {"dropped": [], "n": len(calls)}

    j = Janitor(sweep, 0.01)
    assert j.run() == {"dropped": [], "n": 1}
    t = threading.Thread(target=j.run)
    t.start()
    busy.wait(10)
    assert j.run() == {"dropped": [], "n": 1} and len(calls) == 2  # the other is still at work
    gate.set()
    t.join()
    j.start()
    while len(calls) < 4:
        time.sleep(0.01)
    j.stop()


def test_keys_and_scopes(spark):
    table = auth.new_keys(spark, [("a", "one", None), ("b", "two", ["admin"])])
    again = auth.register(table, auth.new_keys(spark, [("b", "zwei", ["query"]), ("c", "three", ["ingest"])]))
    assert {r.name: sorted(r.scopes) for r in again.collect()} == {"one": ["ingest", "query"], "zwei": ["query"], "three": ["ingest"]}
    assert again.where("created_at is null or length(key_hash) <> 64").count() == 0
    auth.authorise(spark, again, {"Authorization": "Bearer b"}, "query")
    auth.authorise(spark, again, {"x-api-key": "a"}, "ingest")
    auth.authorise(spark, again, {}, "admin", enabled=False)
    for headers, status in (({}, 401), ({"X-API-Key": "no"}, 401), ({"Authorization": "Basic b"}, 401), ({"X-API-Key": "c"}, 403)):
        with pytest.raises(RequestError) as e:
            auth.authorise(spark, again, headers, "query")
        assert e.value.status == status


def test_config():
    assert Config.read({}) == Config() and Config.read({"LOGMILL_RETENTION_DAYS": "7", "LOGMILL_AUTH_ENABLED": "1"}) == Config(retention_days=7, auth_enabled=True)
    for name, value in (("RETENTION_DAYS", "0"), ("RETENTION_DAYS", "x"), ("AUTH_ENABLED", "yes"), ("LOG_LEVEL", "loud")):
        with pytest.raises(ValueError):
            Config.read({f"LOGMILL_{name}": value})


def test_json_log_lines():
    r = logging.makeLogRecord({"name": "logmill.x", "levelname": "INFO", "msg": "n is %s", "args": (5,), "batch": 3})
    line = json.loads(JsonFormatter().format(r))
    assert (line["level"], line["message"], line["batch"]) == ("info", "n is 5", 3) and line["time"].endswith("Z")


def test_queries_end_in_time(spark):
    assert within(spark, 60, lambda: spark.range(10).count()) == 10
    with pytest.raises(RequestError) as e:
        within(spark, 1, lambda: spark.range(1 << 40).agg(F.max(F.xxhash64("id"))).collect())
    assert e.value.status == 503


def test_statistics_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 3 == 0], rng.choice([None, float(rng.randrange(30)), rng.random()])) for i in range(3000)] + [(9000, "n", None)]
    df = spark.createDataFrame(rows, "i long, g string, v double").repartition(3)
    for r in stats.summary(df, "v", ["g"]).collect():
        v = sorted(x for _, g, x in rows if g == r.g and x is not None)
        assert r["count"] == len(v) and [r.p50, r.p90, r.p95, r.p99, r.max] == ([v[math.ceil(f * len(v)) - 1] for f in (0.5, 0.9, 0.95, 0.99)] + [v[-1]] if v else [None] * 5)
    whole = stats.summary(df, "v").head()
    assert whole["count"] == sum(x is not None for _, _, x in rows)
    assert stats.summary(df.limit(0), "v").head()["count"] == 0
    got = {r.i: (r.ring_count, r.ring_max) for r in stats.running_max(df, "v", "i", ["g"], size=7).collect()}
    for g in "abn":
        own = [(i, x) for i, y, x in rows if y == g]
        for k, (i, _) in enumerate(own):
            frame = [x for _, x in own[max(0, k - 6) : k + 1] if x is not None]
            assert got[i] == (len(frame), max(frame, default=None))


def test_generated_logs(spark):
    a, b = (generate.generate(spark, 2000, NOW, 3, partitions=p) for p in (2, 5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    shares = [a.where(F.col("level_code") == c).count() / 2000 for c in range(4)]
    assert all(abs(s - w / 100) < 0.03 for s, w in zip(shares, generate.SHARES, strict=True))
    (one,) = generate.bodies(a.where("id <= 5"), 5).collect()
    assert len(json.loads(one.value)["logs"]) == 5


def test_service(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(body(entry(), entry(timestamp="1999-01-01T00:00Z"), entry(level="x")))
    config = Config(**{name: str(tmp_path / name) for name in ("logs_path", "rejected_path", "checkpoint_path")}, batch_seconds=1, auth_enabled=True, retention_days=3650, log_level="error")
    s = Service.start(spark, str(tmp_path / "in"), config)
    try:
        s.query.processAllAvailable()
        keys = auth.new_keys(spark, [("k", "one", None)])
        assert s.healthy() and len(s.page({}, keys, {"X-API-Key": "k"})["logs"]) == 2
        assert s.janitor.run()["dropped"] == ["1999-01-01"]
        got = s.buckets({"since": "2026-07-20T00:00:00Z", "until": "2026-07-21T00:00:00Z", "bucket": "1d"}, keys, {"Authorization": "Bearer k"})
        assert got == {"buckets": [{"start": "2026-07-20T00:00:00Z", "group": None, "count": 1}]}
        with pytest.raises(RequestError) as e:
            s.page({}, keys, {})
        assert e.value.status == 401
    finally:
        assert s.stop(30)
    assert not s.healthy()
