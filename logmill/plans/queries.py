"""The engine's registered queries, each with the same query in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import level_code, level_name
from ..functions.timeparse import format_bucket, format_ms, parse_ts, to_us
from ..operators import aggregate, auth, filters, logs, retention, rollup, services, stats, validate
from ..operators.cursor import Cursor
from ..sources import generate, ingest
from .fixtures import DICTIONARY_SQL, LOGS_SQL, dictionary, logs_view

NOW = datetime(2024, 1, 30, 12, tzinfo=UTC)
LATER = datetime(2024, 2, 1, tzinfo=UTC)
RANGE = {"since": "2024-01-05T00:00:00Z", "until": "2024-01-20T12:00:00Z"}
RANGE_SQL = "ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20 12:00:00'"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_ROW = ["id", "ts", "level_code", "service", "message", "attributes"]
_ROW_SQL = ", ".join(_ROW)
_LEVEL_SQL = "case level_code when 0 then 'debug' when 1 then 'info' when 2 then 'warn' else 'error' end"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _counts_sql(width: str, key: str | None = None, where: str = "true") -> str:
    return f"select time_bucket(interval '{width}', ts, timestamp '1970-01-01') as start, {key or 'null::varchar'} as key, count(*) as count from {LOGS_SQL} where {where} group by 1, 2"


def _aggregated(name: str, bucket: str, width: str, group: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate.counts(logs_view(spark, sf_dir), bucket, group)

    run.__name__ = name
    query(_counts_sql(width, {"service": "service", "level": "level_code"}.get(group)))(run)


for _b, _w in (("1m", "1 minute"), ("5m", "5 minutes"), ("1h", "1 hour"), ("1d", "1 day")):
    _aggregated(f"agg_{_b}", _b, _w)
    _aggregated(f"agg_{_b}_by_service", _b, _w, "service")
    _aggregated(f"agg_{_b}_by_level", _b, _w, "level")


def _filtered(name: str, params: dict[str, str] | list[tuple[str, str]], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return filters.LogFilters.parse(params).apply(logs_view(spark, sf_dir)).select(*_ROW)

    run.__name__ = name
    query(f"select {_ROW_SQL} from {LOGS_SQL} where {where}")(run)


_filtered("filter_none", {}, "true")
_filtered("filter_time_range", RANGE, RANGE_SQL)
_filtered("filter_since", {"since": RANGE["since"]}, "ts >= timestamp '2024-01-05'")
_filtered("filter_until", {"until": RANGE["until"]}, "ts < timestamp '2024-01-20 12:00:00'")
_filtered("filter_empty_range", {"since": RANGE["since"], "until": RANGE["since"]}, "false")
_filtered("filter_service", {"service": "svc-3"}, "service = 'svc-3'")
_filtered("filter_level", {"level": "warn"}, "level_code = 2")
_filtered("filter_attr", {"attr.k": "87"}, "json_extract_string(attributes, '$.k') = '87'")
_filtered("filter_attr_contradiction", [("attr.k", "87"), ("attr.k", "88")], "false")
_filtered("filter_attr_missing", {"attr.no.such'key": "1"}, "false")
_filtered("filter_q", {"q": "CLICK BY user 1"}, "message ilike '%CLICK BY user 1%'")
_filtered("filter_all", RANGE | {"service": "svc-4", "level": "info", "attr.k": "61", "q": "view"}, f"{RANGE_SQL} and service = 'svc-4' and level_code = 1 and json_extract_string(attributes, '$.k') = '61' and message ilike '%view%'")
_filtered("unknown_service_empty", {"service": "no-such"}, "service = 'no-such'")


@query(f"select {_ROW_SQL.replace('attributes', 'two as attributes')} from (select *, replace(attributes, '}}', ', \"a.b\": \"' || cast(id % 3 as varchar) || '\"}}') as two from {LOGS_SQL}) l where id % 3 = 1 and json_extract_string(attributes, '$.k') = '87'")
def filter_attr_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two attributes of each log, a key with a dot among them; both have to match, as text."""
    two = F.regexp_replace("attributes", r"\}$", "").alias("x")
    rows = logs_view(spark, sf_dir).withColumn("attributes", F.concat(two, F.lit(', "a.b": "'), (F.col("id") % 3).cast("string"), F.lit('"}')))
    return filters.LogFilters.parse({"attr.k": "87", "attr.a.b": "1"}).apply(rows).select(*_ROW)


@query(r"select doc_id, text from documents where text ilike '%\%%' escape '\'")
def filter_q_literal_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal substring filter over documents, as q matches a message."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").withColumn("message", F.col("text"))
    return filters.LogFilters.parse({"q": "%"}).apply(docs).select("doc_id", "text")


@query(f"select strftime(start, '%Y-%m-%dT%H:%M:%SZ') as start, {_LEVEL_SQL.replace('level_code', 'key')} as \"group\", count from ({_counts_sql('1 hour', 'level_code', RANGE_SQL + " and message ilike '%user 1%'")}) c")
def aggregate_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole aggregate request, from its parameters to its formatted rows."""
    return aggregate.aggregate(logs_view(spark, sf_dir), RANGE | {"bucket": "1h", "group_by": "level", "q": "user 1"})


@query(f"select strftime(start, '%Y-%m-%dT%H:%M:%SZ') as start, key as \"group\", count from ({_counts_sql('1 day', 'service', RANGE_SQL)}) c")
def aggregate_request_by_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.aggregate(logs_view(spark, sf_dir), RANGE | {"bucket": "1d", "group_by": "service"})


def _page_sql(where: str, limit: int) -> str:
    return f"select cast(id as varchar) as id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as timestamp, {_LEVEL_SQL} as level, service, message, attributes from {LOGS_SQL} where {where} order by ts desc, logs.id desc limit {limit}"


@query(_page_sql("true", 100))
def page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.records(logs.newest(logs_view(spark, sf_dir), logs.LogQuery()))


@query(_page_sql("(ts, id) < (timestamp '2024-01-15 12:00:00', 500)", 100))
def page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page behind a cursor."""
    cursor = Cursor(1705320000000000, 500).encode()
    return logs.records(logs.newest(logs_view(spark, sf_dir), logs.LogQuery.parse({"cursor": cursor})))


@query(_page_sql(f"{RANGE_SQL} and service = 'svc-2' and level_code = 0", 50))
def page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.records(logs.newest(logs_view(spark, sf_dir), logs.LogQuery.parse(RANGE | {"service": "svc-2", "level": "debug", "limit": "50"})))


def _with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).select("id", F.substring("service", 5, 9).cast("int").alias("service_id"))


@query(f"select id, l.service_id, coalesce(name, 'unknown-' || cast(l.service_id as varchar)) as service from (select id, cast(substr(service, 5) as integer) as service_id from {LOGS_SQL}) l left join {DICTIONARY_SQL} on l.service_id = dict.service_id")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.with_names(_with_ids(spark, sf_dir), dictionary(spark)).select("id", "service_id", "service")


@query(f"select id, service, service_id from {LOGS_SQL} join {DICTIONARY_SQL} on name = service")
def dictionary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = services.of_services(logs_view(spark, sf_dir).select("id", "service"), dictionary(spark))
    return services.with_ids(registered, dictionary(spark)).select("id", "service", "service_id")


@query(f"select distinct service from {LOGS_SQL} where not exists (select 1 from {DICTIONARY_SQL} where name = service)")
def dict_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.unregistered(logs_view(spark, sf_dir), dictionary(spark))


@query(f"select {_ROW_SQL} from {LOGS_SQL} where exists (select 1 from {DICTIONARY_SQL} where name = service)")
def dict_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.of_services(logs_view(spark, sf_dir).select(*_ROW), dictionary(spark))


@query(f"select service_id, name from {DICTIONARY_SQL} union all select cast(6 + row_number() over (order by service) as integer), service from (select distinct service from {LOGS_SQL} where not exists (select 1 from {DICTIONARY_SQL} where name = service)) n")
def dict_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.register(logs_view(spark, sf_dir), dictionary(spark))


@query("select n_nationkey as k, case when n_nationkey < 5 then 'new' else n_name end as name from nation")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of equal key are replaced."""
    nation = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return services.upsert(nation, nation.where("k < 5").withColumn("name", F.lit("new")), "k")


@query(f"select distinct service from {LOGS_SQL}")
def distinct_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).select("service").distinct()


@query(f"select count(*) as count from {LOGS_SQL}")
def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).agg(F.count("*").alias("count"))


@query(f"select level_code, count(*) as count from {LOGS_SQL} group by 1")
def count_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).groupBy("level_code").agg(F.count("*").alias("count"))


@query(f"select min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day from {LOGS_SQL}")
def day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).agg(F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day"))


_PERCENTILES = "count(value) as count, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.9) as p90, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max"


@query(f"select service, {_PERCENTILES} from {LOGS_SQL} group by service")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(logs_view(spark, sf_dir), "value", ["service"]).withColumn("mean", F.round("mean", 6))


@query(f"select {_PERCENTILES} from (select * from {LOGS_SQL} order by id desc limit 4096) t")
def trailing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trailing(logs_view(spark, sf_dir), "value", "id").withColumn("mean", F.round("mean", 6))


@query(f"select id, service, value, count(value) over w as ring_count, max(value) over w as ring_max from {LOGS_SQL} window w as (partition by service order by id rows between 4095 preceding and current row)")
def ring_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.running_max(logs_view(spark, sf_dir).select("id", "service", "value"), "value", "id", ["service"])


@query(f"select time_bucket(interval '1 minute', ts, timestamp '1970-01-01') as bucket, service, level_code, count(*) as n from {LOGS_SQL} group by all")
def rollup_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(logs_view(spark, sf_dir))


_CLOSED = datetime(2024, 1, 20, 12, 34, tzinfo=UTC)


@query(_counts_sql("1 hour", "service"))
def rollup_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, from the rollup up to a minute amid an hour and from raw rows after it."""
    v = logs_view(spark, sf_dir)
    return rollup.counts(rollup.closed(v, _CLOSED), v, _CLOSED, "1h", "service")


@query(f"select {_ROW_SQL} from {LOGS_SQL} where cast(ts as date) >= date '2024-01-23'")
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.survivors(logs_view(spark, sf_dir), 7, NOW).select(*_ROW)


@query(f"select id, epoch_us(ts) as us, cast(floor(epoch_us(ts) / 86400000000) as bigint) as day_index from {LOGS_SQL}")
def ts_to_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).select("id", to_us(F.col("ts")).alias("us"), F.floor(to_us(F.col("ts")) / 86_400_000_000).alias("day_index"))


@query(f"select id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as seconds from {LOGS_SQL}")
def ts_format_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).select("id", format_ms(F.col("ts")).alias("ms"), format_bucket(F.col("ts")).alias("seconds"))


@query(f"select id, ts as parsed from {LOGS_SQL}")
def ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants written with microseconds and parsed again."""
    return logs_view(spark, sf_dir).select("id", parse_ts(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz").alias("parsed"))


@query(f"select id, {_LEVEL_SQL} as level, level_code as code from {LOGS_SQL}")
def level_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).select("id", level_name(F.col("level_code")).alias("level")).withColumn("code", level_code(F.col("level")))


def _entries(v: DataFrame) -> DataFrame:
    """v with the entry of each log: every fifth level is wrong, every seventh message empty."""
    return v.withColumn("entry", F.struct(format_ms(F.col("ts")).alias("timestamp"), F.when(F.col("id") % 5 == 0, "fatal").otherwise(level_name(F.col("level_code"))).alias("level"), "service", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("message")).alias("message"), F.from_json("attributes", "map<string,int>").alias("attributes")))


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body for each log."""
    v = _entries(logs_view(spark, sf_dir))
    # bodies come from many clients: spread them as if they had
    return v.select("id", F.to_json(F.struct(F.array("entry").alias("logs"))).alias("value")).repartition(spark.sparkContext.defaultParallelism)


@query(f"select id, case when id % 5 = 0 then 'invalid level: ''fatal''' when id % 7 = 0 then 'message must be a non-empty string' end as reason, case when id % 5 <> 0 then level_code else -1 end as level_code, service, replace(attributes, ' ', '') as attributes from {LOGS_SQL}")
def validate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(ingest.entries(_wire(spark, sf_dir)), LATER).select("id", "reason", F.coalesce("level_code", F.lit(-1)).alias("level_code"), "service", "attributes")


@query(f"select count(*) filter (id % 5 <> 0 and id % 7 <> 0) as accepted, count(*) filter (id % 5 = 0 or id % 7 = 0) as rejected from {LOGS_SQL}")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = validate.validate(ingest.entries(_wire(spark, sf_dir)), LATER)
    return checked.agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


def _folder(spark: SparkSession) -> str:
    """A fresh folder where driver and executors both reach it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='logmill-')}"
    return f"{root.rstrip('/')}/logmill-{uuid.uuid4().hex}"


def _ingested(spark: SparkSession, sf_dir: str) -> str:
    """A table of all logs but those without a message, ingested in three batches of several bodies."""
    path = _folder(spark)
    rows = _entries(logs_view(spark, sf_dir)).select("id", "entry")
    bodies = rows.groupBy((F.col("id") % 3).alias("batch"), F.floor(F.col("id") / 400).alias("b")).agg(F.to_json(F.struct(F.collect_list("entry").alias("logs"))).alias("value"))
    bodies = bodies.select("batch", F.concat_ws("-", "batch", "b").alias("path"), "value")
    for batch in range(3):
        ingest.write(spark, bodies.where(F.col("batch") == batch).select("path", "value"), path, f"{path}-rejected", f"b{batch}", LATER)
    return path


@query(f"select count(*) as n, count(distinct ids.i) as ids, true as in_range, count(distinct cast(ts as date)) as days from {LOGS_SQL}, (select row_number() over () as i, event_id from events) ids where ids.event_id = logs.id and logs.id % 7 <> 0 and logs.id % 5 <> 0")
def ingest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over several batches, bodies and partitions: each is there once, and none is above the number of entries."""
    rows = ingest.read_logs(spark, _ingested(spark, sf_dir))
    total = logs_view(spark, sf_dir).agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.bool_and(F.col("id").between(1, F.col("total"))).alias("in_range"), F.count_distinct("day").alias("days"))


@query(f"select cast(ts as date) as day, count(*) as n from {LOGS_SQL} where id % 7 <> 0 and id % 5 <> 0 and cast(ts as date) >= date '2024-01-23' group by 1")
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day of a table whose old days a sweep has dropped."""
    path = _ingested(spark, sf_dir)
    retention.retain(spark, path, 7, NOW)
    return ingest.read_logs(spark, path).groupBy("day").agg(F.count("*").alias("n"))


@query("select * from (values (1, 'a', 200), (2, 'b', 403), (3, 'none', 401), (4, null, 401), (5, 'c', 200)) t(id, key, status)")
def auth_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that need the scope query, with keys of several scopes; c was registered twice."""
    table = auth.register(auth.new_keys(spark, [("a", "one", None), ("b", "two", ["ingest"]), ("c", "three", ["admin"])]), auth.new_keys(spark, [("c", "three", ["admin", "query"])]))
    requests = spark.createDataFrame([(1, "a"), (2, "b"), (3, "none"), (4, None), (5, "c")], "id int, key string")
    return auth.allowed(requests, table, "query").select("id", "key", "status")


@query("select 1000000::bigint as n, 1000000::bigint as ids, 30::bigint as days, 8::bigint as services, 4::bigint as levels")
def generated_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A million generated logs over 30 days."""
    rows = generate.generate(spark, 1_000_000, datetime(2024, 1, 1, tzinfo=UTC), 30)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("service").alias("services"), F.count_distinct("level_code").alias("levels"))


@query(f"select id, '{{\"id\":\"' || cast(id as varchar) || '\",\"level\":\"' || {_LEVEL_SQL} || '\",\"attributes\":' || replace(attributes, ' ', '') || '}}' as json from {LOGS_SQL}")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned records as JSON text, attributes as an object."""
    return logs.json_rows(logs_view(spark, sf_dir)).select("id", F.regexp_replace("json", '"timestamp":"[^"]*",|"service":"[^"]*",|"message":"[^"]*",', "").alias("json"))


@query(f"select id, sha256(service) as hash from {LOGS_SQL}")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_view(spark, sf_dir).select("id", F.sha2("service", 256).alias("hash"))
