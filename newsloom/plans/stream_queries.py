"""Streaming programs as queries: each runs over all that is there, leaves its result in the shared folder and reads it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..params import DEFAULT as P
from ..sources.fixtures import table, with_views
from ..storage import fresh_path
from ..streaming import gate_stream, timers, windows
from ..streaming.known_urls import KnownUrls, of_articles

QUERIES = {}


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    # as a pattern, since a stream takes a path without one for a folder, and tables are folders or single files
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _events(spark: SparkSession, d: str, *also: str) -> DataFrame:
    rows = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("event_id", F.col("user_id").alias("chat_id"), F.col("event_type").alias("topic"), "ts", *[F.least("value", F.lit(100.0)).alias(c) for c in also])


def _result(spark: SparkSession, rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    path = fresh_path(spark, name)
    windows.into_table(rows, path, fresh_path(spark, f"{name}-state"), mode).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


def _updates(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, name)
    windows.into_table(rows, path, fresh_path(spark, f"{name}-state"), "update").awaitTermination()
    return spark.read.schema(StructType([*rows.schema, StructField("batch", LongType())])).parquet(path)


def stream_gate(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "pages").where("page_id % 3 = 0")
    raw = _stream(spark, d, "pages").select(F.col("page_id").alias("seq"), "url", "html")
    kept, ledger = fresh_path(spark, "gate-kept"), fresh_path(spark, "gate-ledger")
    gate_stream.gated(raw, known, kept, ledger, F.contains("html", F.lit('lang="en"')), fresh_path(spark, "gate-state")).awaitTermination()
    return spark.read.schema("seq bigint, url string, html string").parquet(kept).select("seq", "url")


QUERIES["stream_gate"] = (
    stream_gate,
    "select min(page_id) as seq, url from pages where coalesce(url, '') <> '' and contains(html, 'lang=\"en\"') and url not in (select url from pages where page_id % 3 = 0) group by url",
)
def stream_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What the gate's stream turned away, with hits."""
    known = table(spark, d, "pages").where("page_id % 3 = 0")
    raw = _stream(spark, d, "pages").select(F.col("page_id").alias("seq"), "url", "html")
    kept, ledger = fresh_path(spark, "gate-kept"), fresh_path(spark, "gate-ledger")
    gate_stream.gated(raw, known, kept, ledger, F.contains("html", F.lit('lang="en"')), fresh_path(spark, "gate-state")).awaitTermination()
    return gate_stream.hits(spark, ledger)


QUERIES["stream_ledger"] = (
    stream_ledger,
    "select url, 'off_topic' as reason, seq as first_seen, 1::bigint as hits from (select *, row_number() over (partition by url order by seq) as turn from (select page_id as seq, url, html from pages) a) b where turn = 1 and coalesce(url, '') <> '' and not contains(html, 'lang=\"en\"') and url not in (select url from pages where page_id % 3 = 0)",
)


#: Pages as they come again: under aliases that are known, and under urls that lead to another page's.
ROUTES = """
raw as (select page_id as seq, url, html, case when page_id % 4 = 1 then 'http://canon/' || (page_id // 8) end as leads, case when page_id % 50 = 7 then null else page_id % 100 end as age from pages
        union all select page_id + 1000000, 'http://alias/' || page_id, html, null, 1 from pages where page_id % 6 = 0),
known as (select url from pages where page_id % 3 = 0 union select 'http://alias/' || page_id from pages where page_id % 3 = 0),
st as (select *, coalesce(leads, url) as to_url, row_number() over (partition by url order by seq) as turn from raw),
g as (select *, case when coalesce(url, '') = '' then 'empty' when turn > 1 then 'repeated' when url in (select url from known) then 'stored' when not (contains(html, 'lang="en"') or seq % 9 = 0) then 'off_topic'
      when age is null then 'no_pubdate' when age <= 6 then 'notify' when age <= 72 then 'backfill' else 'stale' end as stage from st),
f as (select *, stage in ('notify', 'backfill') as passed, min(case when stage in ('notify', 'backfill') then seq end) over (partition by to_url) as first from g),
h as (select *, case when passed and (seq > first or to_url in (select url from known)) then 'alias' else stage end as done from f)
"""


def _routes(spark: SparkSession, d: str) -> tuple[str, str, KnownUrls]:
    """Runs the gate's stream; where its rows, its ledger and the known urls are."""
    pages = table(spark, d, "pages")
    known = KnownUrls(fresh_path(spark, "known-urls"), 64)
    known.remember(of_articles(pages.where("page_id % 3 = 0").select("url", F.array(F.concat(F.lit("http://alias/"), "page_id")).alias("aliases"))), gate_stream.BEFORE)
    raw = _stream(spark, d, "pages")
    again = raw.where("page_id % 6 = 0").select((F.col("page_id") + 1000000).alias("seq"), F.concat(F.lit("http://alias/"), "page_id").alias("url"), "html", F.lit(None).cast("string").alias("leads"), F.lit(1).cast("bigint").alias("age"))
    leads = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("http://canon/"), F.floor(F.col("page_id") / 8)))
    rows = raw.select(F.col("page_id").alias("seq"), "url", "html", leads.alias("leads"), F.when(F.col("page_id") % 50 != 7, F.col("page_id") % 100).alias("age")).unionByName(again)
    kept, ledger = fresh_path(spark, "routes-kept"), fresh_path(spark, "routes-ledger")
    gate_stream.routed(rows, known, kept, ledger, F.contains("html", F.lit('lang="en"')), fresh_path(spark, "routes-state"), age_hours=F.col("age"), canonical="leads", trusted=F.col("seq") % 9 == 0).awaitTermination()
    return kept, ledger, known


QUERIES["stream_routes"] = (
    lambda s, d: s.read.schema("seq bigint, url string, stage string").parquet(_routes(s, d)[0]).select("seq", "url", "stage"),
    f"with {ROUTES.strip()} select seq, url, done as stage from h where done in ('notify', 'backfill')",
)
QUERIES["stream_known_urls"] = (
    lambda s, d: _routes(s, d)[2].read(s).select("url", "why", "article", "seen"),
    f"""with {ROUTES.strip()}, k as (
select url, 'stored' as why, url as article, 0 as seen from pages where page_id % 3 = 0 union all select 'http://alias/' || page_id, 'alias', url, 0 from pages where page_id % 3 = 0
union all select url, 'stored', to_url, seq from h where done in ('notify', 'backfill') union all select to_url, 'stored', to_url, seq from h where done in ('notify', 'backfill') and to_url <> url
union all select url, 'alias', to_url, seq from h where done = 'alias' and url <> to_url union all select url, done, to_url, seq from h where done in ('off_topic', 'stale', 'no_pubdate'))
select url, why, min(article) as article, min(seen)::bigint as seen from k where coalesce(url, '') <> '' group by 1, 2""",
)
QUERIES["stream_daily_counts"] = (
    lambda s, d: windows.newest(_updates(s, windows.daily_counts(_events(s, d), "ts", "topic"), "daily"), "day", "topic"),
    with_views("select ts::date as day, topic, count(*) as n from queue group by 1, 2", "queue"),
)


def _to_the_end(spark: SparkSession, d: str, make, name: str) -> DataFrame:
    """The result of an append stream over the events, with a clock beside them: once all events are in, a row of the clock
    alone moves the watermark past them, so that what timers and windows still hold comes out and their state goes. The
    clock shows the last year that there is, since what is sent in rounds may take centuries: at 12 in six hours it has time
    for 140 million messages a channel."""
    path, state, clock = fresh_path(spark, name), fresh_path(spark, f"{name}-state"), fresh_path(spark, f"{name}-clock")
    ticks = "event_id bigint, chat_id bigint, topic string, ts timestamp, score double, ok boolean, message bigint"
    spark.createDataFrame([], ticks).write.parquet(clock)
    events = _events(spark, d, "score").withColumns({"ok": F.col("event_id") % 4 == 1, "message": F.floor(F.col("event_id") / 7)})
    rows = make(events.select(*[c.split()[0] for c in ticks.split(", ")]).unionByName(spark.readStream.schema(ticks).parquet(clock)))
    with timers.rocksdb(spark):
        windows.into_table(rows, path, state, "append").awaitTermination()
        spark.createDataFrame([(None, None, None, datetime(9999, 1, 1), None, None, None)], ticks).write.mode("append").parquet(clock)
        windows.into_table(rows, path, state, "append").awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


QUERIES["stream_sessions"] = (
    lambda s, d: _to_the_end(s, d, lambda rows: windows.sessions(rows, "ts", "chat_id"), "sessions").where("chat_id is not null").groupBy("chat_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
    with_views(
        "select chat_id, count(*) as sessions, max(n)::bigint as longest from (select chat_id, k, count(*) as n from (select chat_id, sum(new) over (partition by chat_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by chat_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from queue) a) b group by 1, 2) c group by 1",
        "queue",
    ),
)
#: Rounds of six hours take at most 12 of a topic's events, which come at more than that.
ROUND = 21600
SENDS = f"""
a as (select topic, (epoch_us(ts) // 1000 + {1000 * ROUND - 1}) // {1000 * ROUND} as round, list({{'k': -score, 'ms': epoch_us(ts) // 1000, 'id': event_id}}) as items from queue group by 1, 2),
l as (select topic, max(round) as last from a group by 1),
s as (select topic, min(round) - 1 as round, []::struct(k double, ms bigint, id bigint)[] as sent, []::struct(k double, ms bigint, id bigint)[] as rest from a group by 1
      union all select topic, round, q[1:12], q[13:] from (select s.topic, s.round + 1 as round, list_sort(list_concat(s.rest, coalesce(a.items, []))) as q
      from s join l on l.topic = s.topic left join a on a.topic = s.topic and a.round = s.round + 1 where s.round < l.last or len(s.rest) > 0) z)"""
QUERIES["stream_sends"] = (
    lambda s, d: _to_the_end(s, d, lambda rows: timers.sends(rows, "topic", "ts", "score", "event_id", ROUND), "sends"),
    with_views(f"with recursive {SENDS.strip()} select topic as channel, x.id, x.ms as \"at\", round * {1000 * ROUND} as round, turn::int as turn, round * {1000 * ROUND} + (turn - 1) * 3500 as sent from (select topic, round, unnest(sent) as x, unnest(range(1, len(sent) + 1)) as turn from s) z", "queue").replace("with queue", "with recursive queue").replace(", recursive", ","),
)
QUERIES["stream_retries"] = (
    lambda s, d: _to_the_end(s, d, lambda rows: timers.tries(rows, "message", "ts", "ok", "event_id", 24 * 60, 400), "retries"),
    with_views(
        """with a as (select event_id // 7 as message, epoch_us(ts) // 1000 as ms, event_id % 4 = 1 as ok, row_number() over w as n, epoch_us(ts) // 1000 - epoch_us(lag(ts) over w) // 1000 as gap from queue window w as (partition by event_id // 7 order by epoch_us(ts) // 1000, event_id)),
b as (select *, coalesce(max(case when ok or n > 3 then 1 else 0 end) over (partition by message order by n rows between unbounded preceding and 1 preceding), 0) as done, coalesce(max(case when gap > 86400000 then 1 else 0 end) over (partition by message order by n), 0) as late from a),
c as (select * from b where done = 0 and late = 0),
last as (select message, max(n) as n, arg_max(ms, n) as ms, arg_max(ok, n) as ok from c group by 1)
select message, ms as "at", n::int as tries, case when ok then 'sent' when n > 3 then 'failed' else 'retry' end as state from c union all select message, ms + 86400000, n::int, 'failed' from last where not ok and n <= 3""",
        "queue",
    ),
)
QUERIES["stream_silences"] = (
    lambda s, d: _to_the_end(s, d, lambda rows: timers.silences(rows, "topic", "ts", P.quote_minutes, "event_id"), "silences"),
    with_views(
        f"with a as (select topic, epoch_us(ts) // 1000 as ms, epoch_us(lag(ts) over w) // 1000 as before, lead(ts) over w is null as ends from queue window w as (partition by topic order by epoch_us(ts) // 1000, event_id)) select topic as source, ms as \"at\", false as stale from a where before is null or ms - before > {60000 * P.quote_minutes} union all select topic, before + {60000 * P.quote_minutes}, true from a where ms - before > {60000 * P.quote_minutes} union all select topic, ms + {60000 * P.quote_minutes}, true from a where ends",
        "queue",
    ),
)
QUERIES["stream_outages"] = (
    lambda s, d: _result(s, windows.outages(_events(s, d), "ts", "topic"), "outages", "append").groupBy("source", "quiet").agg(F.count("*").alias("n")),
    with_views("select source, quiet, count(*) as n from (select topic as source, coalesce(ts - lag(ts) over (partition by topic order by ts) >= interval 30 minute, true) as quiet from queue) z group by 1, 2", "queue"),
)
