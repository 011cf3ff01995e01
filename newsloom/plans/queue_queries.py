"""Queries of notification decisions, windows over events and operational metrics."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import in_night, local_date, local_hour, parse_time
from ..operators import articles as A
from ..operators import gate, items, ops, queue, rollups, rules, stats
from ..params import DEFAULT as P
from ..sources.fixtures import table, view, with_views
from ..storage import written

QUERIES = {}
NOW = datetime(2024, 1, 31)


def _queue(s, d):
    return view(s, d, "queue")


def _sql(sql):
    return with_views(sql, "queue")


ADMIT = "case when topic = 'error' then 'excluded' when chat_id % 17 = 0 then 'suppressed' when date_diff('hour', ts, timestamp '2024-01-31') > 600 then 'backfill' when topic = 'signup' then 'topic_off' when score >= 50 or chat_id % 5 = 0 then 'queued' else 'below' end"


def _age():
    """Hour boundaries between ts and now."""
    return F.timestamp_diff("HOUR", F.date_trunc("hour", F.col("ts").cast("timestamp")), F.lit(NOW).cast("timestamp"))


def _admitted(s, d):
    return _queue(s, d).withColumn("decision", queue.admission(F.col("topic") == "error", F.col("chat_id") % 17 == 0, _age() > 600, F.col("topic") != "signup", F.col("score"), F.col("chat_id") % 5 == 0))


QUERIES["queue_decision"] = (lambda s, d: _admitted(s, d).groupBy("decision").agg(F.count("*").alias("n")), _sql(f"select {ADMIT} as decision, count(*) as n from queue group by 1"))
QUERIES["night_gate"] = (
    lambda s, d: _queue(s, d).select("event_id", queue.sendable(F.hour("ts"), F.col("score"), F.col("chat_id") % 5 == 0).alias("decision"), in_night(F.hour("ts"), *P.night).alias("night")),
    _sql("select event_id, case when hour(ts) >= 23 or hour(ts) < 7 then case when score >= 80 then 'send' else 'wait' end when score >= 50 or chat_id % 5 = 0 then 'send' else 'wait' end as decision, hour(ts) >= 23 or hour(ts) < 7 as night from queue"),
)
QUERIES["send_slots"] = (
    lambda s, d: queue.slots(_queue(s, d), "topic", [F.desc("score"), F.col("ts"), F.col("event_id")]).select("event_id", "turn", F.col("round").cast("long").alias("round"), F.col("minute").cast("long").alias("minute")),
    _sql("select event_id, turn, ceil(turn / 12)::bigint as round, ceil(turn / 17)::bigint as minute from (select event_id, row_number() over (partition by topic order by score desc, ts, event_id) as turn from queue) z"),
)
QUERIES["queue_dedup"] = (
    lambda s, d: queue.once(_queue(s, d), _queue(s, d).where("score > 90").select("chat_id", "topic").distinct(), "chat_id", "topic").select("event_id", "chat_id", "topic"),
    _sql("select event_id, chat_id, topic from (select *, row_number() over (partition by chat_id, topic order by ts, event_id) as rn from queue) z where rn = 1 and not exists (select 1 from queue q where q.score > 90 and q.chat_id = z.chat_id and q.topic = z.topic)"),
)
QUERIES["freshness_route"] = (
    lambda s, d: _queue(s, d).select(gate.fresh_route(F.when(F.col("event_id") % 50 != 0, _age())).alias("route")).groupBy("route").agg(F.count("*").alias("n")),
    _sql("select case when event_id % 50 = 0 then 'no_pubdate' when age <= 6 then 'notify' when age <= 72 then 'backfill' else 'stale' end as route, count(*) as n from (select *, date_diff('hour', ts, timestamp '2024-01-31') as age from queue) z group by 1"),
)
QUERIES["trailing_windows"] = (
    lambda s, d: _queue(s, d).groupBy("topic").agg(*[F.count_if(F.datediff(F.lit(NOW), "ts") < n).alias(f"d{n}") for n in (7, 30, 365)]),
    _sql("select topic, count_if(age < 7)::bigint as d7, count_if(age < 30)::bigint as d30, count_if(age < 365)::bigint as d365 from (select topic, date_diff('day', ts, timestamp '2024-01-31') as age from queue) z group by 1"),
)
QUERIES["daily_counts"] = (
    lambda s, d: _queue(s, d).groupBy(F.to_date("ts").alias("day"), "topic").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("score")),
    _sql("select ts::date as day, topic, count(*) as n, round(sum(score), 4) as score from queue group by 1, 2"),
)
QUERIES["session_rollup"] = (
    lambda s, d: stats.sessions(_queue(s, d).withColumn("ts", F.col("ts").cast("timestamp")), "chat_id", "ts", 1800).groupBy("chat_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")),
    _sql("select chat_id, count(*) as sessions, max(n)::bigint as longest from (select chat_id, k, count(*) as n from (select chat_id, sum(new) over (partition by chat_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by chat_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from queue) a) b group by 1, 2) c group by 1"),
)
QUERIES["success_rate_24h"] = (
    lambda s, d: ops.success(_queue(s, d), "topic", F.col("score") >= 50, datetime(2024, 1, 30)),
    _sql("select topic, count(*) as n, round(count_if(score >= 50) / count(*), 6) as rate from queue where ts >= timestamp '2024-01-29' group by 1"),
)
QUERIES["silent_sources"] = (
    lambda s, d: ops.silent(_queue(s, d).withColumn("src", F.col("chat_id")), table(s, d, "customer").select(F.col("c_custkey").alias("src")), "src", datetime(2024, 1, 20), 24 * 60),
    _sql("select c_custkey as src, last from (select distinct c_custkey from customer) c left join (select chat_id, max(ts) as last from queue where ts <= timestamp '2024-01-20' group by 1) q on chat_id = c_custkey where last is null or last < timestamp '2024-01-19'"),
)
QUERIES["availability"] = (
    lambda s, d: ops.availability(_queue(s, d).where("topic = 'error'"), datetime(2024, 1, 1), datetime(2024, 1, 31)),
    _sql("select count(distinct floor(epoch(ts) / 1800)) as up, round(count(distinct floor(epoch(ts) / 1800)) / 1440, 6) as share, 1440::bigint as slots from queue where topic = 'error' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"),
)
QUERIES["top_ledger_hits"] = (
    lambda s, d: ops.top_hits(_queue(s, d).groupBy(F.concat(F.lit("u"), "chat_id").alias("url")).agg(F.count("*").alias("hits"))),
    _sql("select 'u' || chat_id as url, count(*) as hits from queue group by 1 order by hits desc, url limit 10"),
)
QUERIES["request_identity"] = (
    lambda s, d: ops.request_identity(_queue(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.lit(9).cast("long").alias("sources"), F.count_if(F.col("topic") == "view").alias("new_count"), (F.count_if((F.col("topic") == "view") & (F.col("event_id") % 40 != 0)) + 9).alias("http_request_count"))),
    _sql("select * from (select ts::date as day, 9::bigint as sources, count_if(topic = 'view')::bigint as new_count, (count_if(topic = 'view' and event_id % 40 <> 0) + 9)::bigint as http_request_count, (9 + count_if(topic = 'view'))::bigint as expected from queue group by 1) z where http_request_count <> expected"),
)
QUERIES["p90_latency"] = (
    lambda s, d: _queue(s, d).groupBy("topic").agg(F.round(F.percentile("score", 0.9), 6).alias("p90")),
    _sql("select topic, round(quantile_cont(score, 0.9), 6) as p90 from queue group by 1"),
)
QUERIES["suppressed_runs"] = (
    lambda s, d: queue.suppressed_runs(_queue(s, d).where("topic = 'error'").select(F.col("ts").cast("timestamp").alias("ts")).distinct(), "ts").groupBy("quiet").agg(F.count("*").alias("n")),
    _sql("select quiet, count(*) as n from (select coalesce(epoch(ts)::bigint - lag(epoch(ts)::bigint) over (order by ts) >= 1800, true) as quiet from (select distinct ts from queue where topic = 'error') z) y group by 1"),
)
QUERIES["keyword_rotation"] = (
    lambda s, d: queue.rotated(table(s, d, "part").select(F.col("p_brand").alias("keyword"), F.lit("").alias("category")).distinct(), 1, 2, "always"),
    "select keyword from (select keyword, row_number() over (order by keyword) as rn from (select distinct p_brand as keyword from part) z) y where (rn - 1) % 2 = 1",
)
QUERIES["keyword_slots"] = (
    lambda s, d: queue.rotated(table(s, d, "part").select(F.col("p_type").alias("keyword"), F.when(F.col("p_type").contains("BRASS"), "always").otherwise("rest").alias("category")).distinct(), 5, 3, "always"),
    "select distinct p_type as keyword from part where contains(p_type, 'BRASS') union all select keyword from (select keyword, row_number() over (order by keyword) - 1 as i from (select distinct p_type as keyword from part where not contains(p_type, 'BRASS')) z) y where i % 3 = 5 % 3",
)
QUERIES["keyword_status"] = (
    lambda s, d: A.keyword_status(table(s, d, "part").select(F.col("p_brand").alias("category"), F.col("p_type").alias("keyword"), (F.col("p_partkey") % 3 != 0).alias("enabled")), ("Brand#3", "Brand#1")),
    "select case p_brand when 'Brand#3' then 0 when 'Brand#1' then 1 else 2 end::bigint as position, p_brand as category, count_if(p_partkey % 3 <> 0)::bigint as enabled, count(*) as total from part group by 1, 2",
)
QUERIES["terms_left"] = (
    lambda s, d: rules.terms_without_agencies(view(s, d, "agencies").select(F.explode(F.array("name", "short_name", F.concat(F.lit("k"), "id"))).alias("keyword"), F.when(F.col("id") % 2 == 0, "policy").otherwise("other").alias("category"), (F.col("id") % 5 != 0).alias("enabled")), view(s, d, "agencies"), ("policy",)),
    with_views("select distinct 'k' || id as keyword from agencies where id % 2 = 0 and id % 5 <> 0", "agencies"),
)
QUERIES["quote_change"] = (
    lambda s, d: _queue(s, d).groupBy("topic", F.to_date("ts").alias("day")).agg(F.max_by("score", F.struct("ts", "event_id")).alias("price")).withColumn("change", F.round(F.col("price") - F.lag("price").over(Window.partitionBy("topic").orderBy("day")), 6)).select("topic", "day", "price", "change"),
    _sql("select topic, day, price, round(price - lag(price) over (partition by topic order by day), 6) as change from (select topic, ts::date as day, arg_max(score, (ts, event_id)) as price from queue group by 1, 2) z"),
)
QUERIES["quotes_now"] = (
    lambda s, d: queue.quotes(_queue(s, d).select("event_id", F.col("topic").alias("symbol"), "ts", F.when(F.col("event_id") % 4 != 0, F.col("score")).alias("price"), F.when(F.col("event_id") % 8 == 0, F.col("score") / 2).alias("fallback")), "symbol", "ts", datetime(2024, 1, 30, 23, 50)).select("symbol", F.round("price", 6).alias("price"), "at", "stale"),
    _sql("select topic as symbol, round(arg_max(price, (ts, event_id)), 6) as price, max(ts) as at, max(ts) + interval 15 minute < timestamp '2024-01-30 23:50:00' as stale from (select *, case when event_id % 4 <> 0 then score when event_id % 8 = 0 then score / 2 end as price from queue) z where price is not null group by 1"),
)
QUERIES["chat_limits"] = (
    lambda s, d: _queue(s, d).groupBy("chat_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).where("n > 1").groupBy("chat_id").agg(F.count("*").alias("hours")),
    _sql("select chat_id, count(*) as hours from (select chat_id, date_trunc('hour', ts) as h, count(*) as n from queue group by 1, 2 having count(*) > 1) z group by 1"),
)
QUERIES["spend_per_day"] = (
    lambda s, d: _queue(s, d).where("topic = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.round(F.count("*") * 0.00133, 6).alias("cost")),
    _sql("select ts::date as day, count(*) as calls, round(count(*) * 0.00133::double, 6) as cost from queue where topic = 'view' group by 1"),
)

# --- state of messages and runs ------------------------------------------------------------------------------------------

QUERIES["queue_reasons"] = (
    lambda s, d: _queue(s, d).select(
        queue.admission(F.col("topic") == "error", F.col("chat_id") % 17 == 0, F.lit(False), F.lit(True), F.col("score"), F.col("chat_id") % 5 == 0, topic=queue.topic_match(F.col("topic"), ("view", "click"), ("ie", "li"), ("zzz",)), published=F.col("ts"), first_run=F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz")).alias("decision")
    ).groupBy("decision").agg(F.count("*").alias("n")),
    _sql("select case when topic = 'error' then 'excluded' when chat_id % 17 = 0 then 'suppressed' when not (score >= 50 or chat_id % 5 = 0 or topic in ('view', 'click')) then 'below' when ts < timestamp '2024-01-03' then 'before_first_run' else 'queued' end as decision, count(*) as n from queue group by 1"),
)
QUERIES["send_decisions"] = (
    lambda s, d: _queue(s, d).select(
        "event_id", queue.send_gate(F.col("event_id") % 101 == 0, F.col("topic") == "error", F.when(F.col("chat_id") % 7 == 0, F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")), F.col("ts"), local_hour(F.col("ts").cast("timestamp"), P.tz), F.col("score"), F.col("chat_id") % 5 == 0, True).alias("decision")
    ),
    _sql("select event_id, case when event_id % 101 = 0 then 'hold' when topic = 'error' then 'drop' when chat_id % 7 = 0 and timestamp '2024-01-15' > ts then 'skip' when h >= 23 or h < 7 then case when score >= 80 or chat_id % 5 = 0 then 'send' else 'wait' end when score >= 50 or chat_id % 5 = 0 then 'send' else 'wait' end as decision from (select *, hour(ts + interval 9 hour) as h from queue) z"),
)
QUERIES["night_blocked"] = (
    lambda s, d: _queue(s, d).groupBy(queue.sendable(F.lit(2), F.col("score"), F.col("chat_id") % 5 == 0, True, replace(P, night_least=101.0)).alias("decision")).agg(F.count("*").alias("n")),
    _sql("select case when chat_id % 5 = 0 then 'send' else 'wait' end as decision, count(*) as n from queue group by 1"),
)
QUERIES["retries"] = (
    lambda s, d: queue.retried(_queue(s, d).select("chat_id", "topic", (F.col("event_id") % 29 == 0).alias("ok")), "chat_id", "topic"),
    _sql("select chat_id, topic, count(*) as tries, case when count_if(event_id % 29 = 0) > 0 then 'sent' when count(*) > 3 then 'failed' else 'queued' end as state from queue group by 1, 2"),
)
QUERIES["due_slots"] = (
    lambda s, d: _queue(s, d).select("event_id", queue.due_slot(F.col("ts"), F.when(F.col("event_id") % 3 != 0, F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") % 12).cast("int")))).alias("x")).select("event_id", "x.slot", "x.run"),
    _sql("select event_id, slot, coalesce(slot is not null and (last is null or last + interval 1 hour <= ts) and (last is null or last < slot), false) as run from (select *, case when hour(ts) >= 15 then date_trunc('day', ts) + interval 15 hour when hour(ts) >= 9 then date_trunc('day', ts) + interval 9 hour end as slot, case when event_id % 3 <> 0 then ts - to_hours(event_id % 12) end as last from queue) z"),
)
QUERIES["budgets"] = (
    lambda s, d: _queue(s, d).groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("topic") == "error").alias("own"), F.count_if(F.col("topic").isin("error", "signup")).alias("all")).select("day", queue.budget(F.col("own"), F.col("all")).cast("long").alias("left")),
    _sql("select ts::date as day, greatest(0, least(50 - count_if(topic = 'error'), 100 - count_if(topic in ('error', 'signup'))))::bigint as left from queue group by 1"),
)
QUERIES["backlog_plan"] = (
    lambda s, d: queue.backlog(items.unanalysed(view(s, d, "items"), view(s, d, "analyses")), ("policy_press",), 20).select("id", "by"),
    with_views("with u as (select * from items where not exists (select 1 from analyses a where a.policy_item_id = items.id)) select id, 'rule' as by from u where item_type = 'policy_press' union all select id, 'model' from (select * from u where item_type <> 'policy_press' order by notice_end asc nulls last, id limit 20) z", "items", "analyses"),
)
QUERIES["recovery_runs"] = (
    lambda s, d: queue.recovering(_queue(s, d).groupBy(F.date_trunc("hour", "ts").alias("at")).agg(F.count("*").alias("candidates"), F.count_if(F.col("topic") == "view").alias("fresh"), F.count_if(F.col("topic") == "error").alias("backlog")).withColumn("quiet", F.hour("at") == 5), "at").groupBy("suppressed").agg(F.count("*").alias("n")),
    _sql("with r as (select date_trunc('hour', ts) as ran, count(*) as c, count_if(topic = 'view') as f, count_if(topic = 'error') as b from queue group by 1), o as (select *, hour(ran) = 5 as quiet, c < 20 and f < 10 and b < 10 as calm, sum((hour(ran) = 5)::int) over (order by ran) as k from r), m as (select *, coalesce(max(calm::int) over (partition by k order by ran rows between unbounded preceding and 1 preceding), 0) as ended from o) select k > 0 and ended = 0 as suppressed, count(*) as n from m group by 1"),
)
QUERIES["chat_allowed"] = (
    lambda s, d: queue.chat_answers(_queue(s, d).withColumn("chat_id", F.col("chat_id") % 2), "chat_id", "ts", replace(P, chat_questions=3)).groupBy("allowed").agg(F.count("*").alias("n")),
    _sql("select rn <= 3 as allowed, count(*) as n from (select row_number() over (partition by chat_id % 2, date_trunc('hour', ts) order by ts, event_id) as rn from queue) z group by 1"),
)
for _name, _args, _where in (("latest", {}, "true"), ("today", {}, "published_on = date '2024-01-30'"), ("threshold", {"threshold": 90}, "importance_score >= 90"), ("filter", {"text": "der"}, "contains(title, 'der')")):
    QUERIES[f"command_{_name}"] = (
        lambda s, d, n=_name, a=_args: queue.command(view(s, d, "articles_full"), n, date(2024, 1, 30), **a).select("id", "published_on"),
        with_views(f"select id, published_on from articles_full where {_where} order by published_on desc, id desc limit 5", "articles_full"),
    )
QUERIES["draft_states"] = (
    lambda s, d: queue.drafts(
        _queue(s, d).select(F.concat(F.lit("u"), "chat_id").alias("url"), F.when(F.col("topic") == "error", "discard").when(F.col("topic") == "signup", "confirm").otherwise("submit").alias("action"), F.col("ts").alias("at"), "event_id"), _queue(s, d).where("chat_id % 10 = 0").select(F.concat(F.lit("u"), "chat_id").alias("url")), datetime(2024, 1, 31)
    ),
    _sql("select 'u' || chat_id as url, case when chat_id % 10 = 0 then 'existing' when t = 'signup' then 'confirmed' when t = 'error' then 'discarded' when last + interval 24 hour < timestamp '2024-01-31' then 'expired' else 'draft' end as state from (select chat_id, arg_max(topic, (ts, event_id)) as t, max(ts) as last from queue group by 1) z"),
)
QUERIES["local_days"] = (
    lambda s, d: _queue(s, d).groupBy(local_date(F.col("ts").cast("timestamp"), P.tz).alias("day")).agg(F.count("*").alias("n")),
    _sql("select (ts + interval 9 hour)::date as day, count(*) as n from queue group by 1"),
)
QUERIES["times_parsed"] = (
    lambda s, d: _queue(s, d).select("event_id", parse_time(F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).otherwise("soon")).alias("at")),
    _sql("select event_id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('second', ts) - interval 9 hour end as at from queue"),
)


def _latencies(s, d):
    """How long each line took from its order to its shipping, as publishing and sending."""
    lines, orders = table(s, d, "lineitem"), table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("published"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("sent", F.to_date("l_shipdate"))
    return rows.select("source", "sent", F.datediff("sent", "published").alias("latency"), "o_custkey")


def latency_windows(s, d, as_of=date(1998, 7, 1), days=(7, 30, 365)):
    """P90 of publishing to sending and distinct receivers by source and window: the exact values, and whether those of the
    merged daily sketches are within the sketches' errors."""
    rows = written(_latencies(s, d), "latencies")
    sketched = rollups.windowed(rollups.daily(rows, "sent", F.col("latency"), F.col("o_custkey"), "source"), "sent", as_of, days, {"p90": 0.9}, "source")
    age = F.datediff(F.lit(as_of), F.col("sent"))
    each = rows.where(age.between(0, max(days) - 1)).withColumn("days", F.explode(F.filter(F.array(*map(F.lit, days)), lambda k: k > age)))
    exact = rollups.exact_quantiles(each, "latency", 0.9, "source", "days").withColumnRenamed("quantile", "exact")
    ranks = each.join(F.broadcast(sketched.select("source", "days", "p90")), ["source", "days"]).groupBy("source", "days").agg(  # a row a source and window
        F.avg((F.col("latency") < F.col("p90")).cast("int")).alias("below"), F.avg((F.col("latency") <= F.col("p90")).cast("int")).alias("upto"), F.count_distinct("o_custkey").alias("receivers")
    )
    e = rollups.RANK_ERROR
    near = (F.col("below") <= 0.9 + e) & (F.col("upto") >= 0.9 - e)
    close = F.abs(F.col("distinct") - F.col("receivers")) <= F.greatest(F.lit(1), rollups.DISTINCT_ERROR * F.col("receivers"))
    done = sketched.join(exact, ["source", "days"]).join(ranks, ["source", "days"])
    return done.select("source", F.col("days").cast("long").alias("days"), "n", F.col("exact").cast("long").alias("p90"), "receivers", near.alias("p90_near"), close.alias("receivers_near"))


QUERIES["latency_windows"] = (
    latency_windows,
    """with l as (select o_orderpriority as source, l_shipdate::date as sent, date_diff('day', o_orderdate::date, l_shipdate::date) as latency, o_custkey from lineitem join orders on l_orderkey = o_orderkey),
w as (select l.*, days from l, (select unnest([7, 30, 365]) as days) z where date_diff('day', sent, date '1998-07-01') between 0 and days - 1)
select source, days::bigint as days, count(*) as n, quantile_disc(latency, 0.9)::bigint as p90, count(distinct o_custkey) as receivers, true as p90_near, true as receivers_near from w group by 1, 2""",
)
