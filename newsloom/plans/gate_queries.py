"""Queries of the gate, the ledger, urls and their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as X
from ..operators import gate, items, sinks
from ..operators import articles as A
from ..params import DEFAULT as P
from ..sources.fixtures import table
from ..storage import fresh_path

QUERIES = {}
RAW = """raw as (select page_id as seq, url, html from pages union all select page_id + 1000000, url, html from pages where page_id % 5 = 0),
st as (select *, row_number() over (partition by url order by seq) as turn from raw),
g as (select *, case when coalesce(url, '') = '' then 'empty' when turn > 1 then 'repeated' when url in (select url from pages where page_id % 3 = 0) then 'stored'
      when url in (select url from pages where page_id % 10 = 1) then 'ledger' when not contains(html, 'lang="en"') then 'off_topic' else 'kept' end as stage from st)"""


def _staged(s, d):
    p = table(s, d, "pages")
    raw = p.select(F.col("page_id").alias("seq"), "url", "html").union(p.where("page_id % 5 = 0").select(F.col("page_id") + 1000000, "url", "html"))
    return gate.staged(raw, p.where("page_id % 3 = 0"), p.where("page_id % 10 = 1"), F.contains("html", F.lit('lang="en"')))


QUERIES["gate_stage_counts"] = (lambda s, d: _staged(s, d).groupBy("stage").agg(F.count("*").alias("n")), f"with {RAW} select stage, count(*) as n from g group by 1")
QUERIES["gate_survivors"] = (lambda s, d: _staged(s, d).where("stage = 'kept'").select("seq", "url"), f"with {RAW} select seq, url from g where stage = 'kept'")
QUERIES["ledger_upsert"] = (
    lambda s, d: sinks.counted(
        table(s, d, "pages").where("page_id % 10 = 1").select("url", F.lit("old").alias("reason"), F.lit(0).cast("long").alias("first_seen"), F.lit(3).cast("long").alias("hits")),
        _staged(s, d).where("stage in ('off_topic', 'ledger')").select("url", F.col("stage").alias("reason"), F.col("seq").alias("seen")),
    ),
    f"with {RAW}, u as (select url, 'old' as reason, 0 as first_seen, 3 as hits from pages where page_id % 10 = 1 union all select url, stage, seq, 1 from g where stage in ('off_topic', 'ledger')) select url, arg_min(reason, (first_seen, reason)) as reason, min(first_seen)::bigint as first_seen, sum(hits)::bigint as hits from u group by 1",
)
QUERIES["interleave_capped"] = (
    lambda s, d: items.interleaved(table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id", 40),
    "select event_id, event_type, turn::int as turn, opened from (select event_id, event_type, row_number() over (partition by event_type order by event_id) as turn, min(event_id) over (partition by event_type) as opened from events) z order by turn, opened limit 40",
)
HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', '')"
QUERIES["url_normalise"] = (
    lambda s, d: table(s, d, "pages").select("page_id", X.normal_url(F.col("url")).alias("canonical")),
    f"""with b as (select page_id, url, regexp_replace(url, '#.*$', '') as bare from pages),
s as (select page_id, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, {HOST} as host, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) as path, string_split(regexp_extract(bare, '\\?(.*)$', 1), '&') as q from b),
f as (select *, array_to_string(list_sort(list_filter(q, lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term') and not starts_with(lower(x), 'utm_'))), '&') as query from s)
select page_id, scheme || '://' || host || case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end || case when query <> '' then '?' || query else '' end as canonical from f""",
)
OUTLETS = "(select distinct regexp_extract({0}, '([^.]+\\.[^.]+)$', 1) as domain from pages where page_id % 4 <> 0)"


def _hosts(s, d):
    rows = table(s, d, "pages").select("page_id", X.host(F.col("url")).alias("host"))
    named = rows.select("page_id", F.explode(X.host_suffixes(F.col("host"))).alias("name"))
    outlets = table(s, d, "pages").where("page_id % 4 <> 0").select(F.regexp_extract(X.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("domain")).distinct().withColumn("outlet", F.concat(F.lit("of "), "domain"))
    return A.with_names(rows, named, outlets)


QUERIES["host_outlets"] = (
    lambda s, d: _hosts(s, d).select("page_id", "outlet"),
    f"with o as {OUTLETS.format(HOST)} select page_id, 'of ' || domain as outlet from pages left join o on domain = regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1)",
)
QUERIES["pending_outlets"] = (
    lambda s, d: A.pending_outlets(_hosts(s, d)),
    f"with o as {OUTLETS.format(HOST)}, h as (select regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) as domain, {HOST} as host from pages) select coalesce(nullif(domain, ''), host) as domain, count(*) as n from h where host <> '' and domain not in (select domain from o) group by 1",
)
QUERIES["host_outlet_match"] = (
    lambda s, d: table(s, d, "pages").select("page_id", F.explode(X.host_suffixes(X.host(F.col("url")))).alias("name")).join(
        table(s, d, "pages").select(F.regexp_extract(X.host(F.col("url")), r"([^.]+\.[^.]+)$", 1).alias("name")).distinct(), "name"
    ).groupBy("page_id").agg(F.max_by("name", F.struct(F.char_length("name"), F.col("name"))).alias("outlet")),
    f"select page_id, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) as outlet from pages",
)
QUERIES["set_ops_known_urls"] = (
    lambda s, d: table(s, d, "pages").where("page_id % 3 = 0").select("url").union(table(s, d, "pages").where("page_id % 10 = 1").select("url")).distinct(),
    "select url from pages where page_id % 3 = 0 union select url from pages where page_id % 10 = 1",
)
QUERIES["set_difference"] = (
    lambda s, d: table(s, d, "pages").select("url").exceptAll(table(s, d, "pages").where("page_id % 3 = 0").select("url")).intersect(table(s, d, "pages").where("page_id % 2 = 0").select("url")),
    "(select url from pages except all select url from pages where page_id % 3 = 0) intersect select url from pages where page_id % 2 = 0",
)
QUERIES["alias_gather"] = (
    lambda s, d: gate.gathered_aliases(table(s, d, "pages").select(X.normal_url(F.col("url")).alias("canonical"), "url"), "canonical", "url").select("canonical", F.array_join("aliases", " ").alias("aliases")),
    QUERIES["url_normalise"][1].replace("select page_id, url, regexp_replace", "select page_id, url, url as original, regexp_replace").replace("select page_id, lower(", "select page_id, original, lower(").replace("select page_id, scheme", "select canonical, string_agg(distinct original, ' ' order by original) as aliases from (select original, scheme") + ") z group by 1",
)
QUERIES["json_props"] = (
    lambda s, d: table(s, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n")),
    "select (props::json->>'$.k')::bigint as k, count(*) as n from events group by 1",
)
QUERIES["lenient_json"] = (
    lambda s, d: table(s, d, "events").select("event_id", F.size(jsonx.string_list(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["a","'), "event_type", F.lit('"]'))).when(F.col("event_id") % 3 == 1, F.col("props")))).cast("long").alias("n")),
    "select event_id, case when event_id % 3 = 0 then 2 else 0 end::bigint as n from events",
)
QUERIES["chip_dedup"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", F.array_join(X.distinct_chips(F.array("n_name", F.lower("n_name"), F.replace(F.col("n_name"), F.lit("_"), F.lit("-")), F.lit("NATION 3"), F.lit("other")), F.array(F.lit("nation-7"))), "|").alias("chips")),
    "select n_nationkey, concat_ws('|', case when n_nationkey <> 7 then n_name end, case when n_nationkey <> 3 then 'NATION 3' end, 'other') as chips from nation",
)

# --- the news gate: aliases, trust, age, overflow ---------------------------------------------------------------------



def _english():
    return F.contains("html", F.lit('lang="en"'))


NEWS = """raw as (select page_id as seq, url, html, page_id % 9 = 0 as trusted, case when page_id % 50 = 7 then null else page_id % 100 end as age from pages),
known as (select url from pages where page_id % 3 = 0 union select 'http://alias/' || page_id from pages where page_id % 3 = 0 union select url from pages where page_id % 6 = 0),
st as (select *, row_number() over (partition by url order by seq) as turn from raw),
g as (select *, case when coalesce(url, '') = '' then 'empty' when turn > 1 then 'repeated' when url in (select url from known) then 'stored' when url in (select url from pages where page_id % 10 = 1) then 'ledger'
      when not (contains(html, 'lang="en"') or trusted) then 'off_topic' when age is null then 'no_pubdate' when age <= 6 then 'notify' when age <= 72 then 'backfill' else 'stale' end as stage from st)"""


def _news(s, d):
    """The gate with trusted rows and known aliases, then routing by age."""
    p = table(s, d, "pages")
    store = gate.with_aliases(p.where("page_id % 3 = 0").select("url", F.array(F.concat(F.lit("http://alias/"), "page_id")).alias("aliases")))
    raw = p.select(F.col("page_id").alias("seq"), "url", "html")
    passed = gate.staged(raw, store, p.where("page_id % 10 = 1"), _english(), trusted=F.col("seq") % 9 == 0)
    return gate.routed(passed, F.when(F.col("seq") % 50 != 7, F.col("seq") % 100))


QUERIES["news_routes"] = (lambda s, d: _news(s, d).groupBy("stage").agg(F.count("*").alias("n")), f"with {NEWS} select stage, count(*) as n from g group by 1")
QUERIES["news_ledger"] = (
    lambda s, d: sinks.counted(
        table(s, d, "pages").where("page_id % 10 = 1").select("url", F.lit("old").alias("reason"), F.lit(0).cast("long").alias("first_seen"), F.lit(1).cast("long").alias("hits")).dropDuplicates(["url"]), gate.rejections(_news(s, d))
    ),
    f"with {NEWS}, u as (select distinct url, 'old' as reason, 0 as first_seen, 1 as hits from pages where page_id % 10 = 1 union all select url, stage, seq, 1 from g where stage in ('off_topic', 'ledger', 'stale', 'no_pubdate')) select url, arg_min(reason, (first_seen, reason)) as reason, min(first_seen)::bigint as first_seen, sum(hits)::bigint as hits from u group by 1",
)
QUERIES["gate_recheck"] = (
    lambda s, d: gate.rechecked(
        _news(s, d).where("stage in ('notify', 'backfill')").select("seq").join(table(s, d, "pages").select(F.col("page_id").alias("seq"), "url", "html"), "seq"), F.contains(gate.probe(F.col("url"), F.lit(None).cast("string"), F.col("html")), F.lit("the")), F.col("seq") % 9 == 0
    ).groupBy("stage").agg(F.count("*").alias("n")),
    f"with {NEWS} select case when contains(concat_ws(chr(10), url, substr(html, 1, 2000)), 'the') or trusted then 'kept' else 'off_topic' end as stage, count(*) as n from g where stage in ('notify', 'backfill') group by 1",
)


def _overflow(s, d):
    rows = _news(s, d).where("stage in ('notify', 'backfill')")
    now, later = gate.split_overflow(rows, [F.col("stage").desc(), F.col("seq")], 10)
    return now.select("seq", F.lit("now").alias("turn")).unionByName(later.select("seq", F.lit("later").alias("turn")))


QUERIES["gate_overflow"] = (_overflow, f"with {NEWS} select seq, case when row_number() over (order by stage desc, seq) <= 10 then 'now' else 'later' end as turn from g where stage in ('notify', 'backfill')")
QUERIES["overflow_count"] = (
    lambda s, d: _news(s, d).where("stage in ('notify', 'backfill')").agg(F.greatest(F.lit(0), F.count("*") - 10).alias("overflow")),
    f"with {NEWS} select greatest(0, count(*) - 10)::bigint as overflow from g where stage in ('notify', 'backfill')",
)
QUERIES["run_log"] = (
    lambda s, d: sinks.run_log(_staged(s, d), P.now, "pages", 9, 1400).drop("run_at"),
    f"with {RAW} select 'pages' as source_type, count(*) as fetched_count, count_if(stage = 'kept')::bigint as new_count, count_if(stage = 'repeated')::bigint as dup_count, count_if(stage in ('stored', 'ledger'))::bigint as skipped_seen_count, 9::bigint as http_request_count, 1400::bigint as duration_ms, null::varchar as error from g",
)
QUERIES["run_log_observed"] = (
    lambda s, d: sinks.logged_write(_staged(s, d), fresh_path(s, "run-stages"), P.now, "pages", 9, 1400).drop("run_at"),
    QUERIES["run_log"][1],
)
QUERIES["recent_cache"] = (
    lambda s, d: gate.recent(table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at")), "at", P.now).agg(F.count("*").alias("n")),
    "select count(*) as n from events where ts >= timestamp '2024-01-28 00:00:00'",
)
QUERIES["url_reasons"] = (
    lambda s, d: table(s, d, "pages").select("page_id", F.size(jsonx.one_or_many(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"u": "'), "page_id", F.lit('"}'))).otherwise('[{"u": "1"}, {"u": "2"}]'))).cast("long").alias("n")),
    "select page_id, case when page_id % 2 = 0 then 1 else 2 end::bigint as n from pages",
)
QUERIES["json_envelopes"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", jsonx.envelope_rows(F.when(F.col("n_nationkey") % 3 == 0, '{"RESULT": {"CODE": "ERROR-1"}}').when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit('{"svc": [{"head": [{"n": 1}]}, {"row": [{"ID": "'), "n_nationkey", F.lit('"}, {"ID": "x"}]}]}'))).otherwise("not json")).alias("r")).select("n_nationkey", F.size("r").cast("long").alias("n"), F.get("r", F.lit(0))["ID"].alias("first")),
    "select n_nationkey, case when n_nationkey % 3 = 1 then 2 else 0 end::bigint as n, case when n_nationkey % 3 = 1 then n_nationkey::varchar end as first from nation",
)
QUERIES["json_recovered"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", jsonx.recovered(F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("Sure {like this}:\n```json\n{\"a\": \""), "n_nationkey", F.lit("\"}\n```\nwith {braces}"))).when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("text {\"a\": \""), "n_nationkey", F.lit("\"} text"))).when(F.col("n_nationkey") % 4 == 2, "[1, 2]").otherwise(F.concat(F.lit("[{\"a\": \""), "n_nationkey", F.lit("\"}]"))), "a string", "a")["a"].alias("a")),
    "select n_nationkey, case when n_nationkey % 4 <> 2 then n_nationkey::varchar end as a from nation",
)
QUERIES["json_encoded"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", jsonx.encoded(F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name", F.lit('"')))).alias("text")),
    "select n_nationkey, case when n_nationkey % 2 = 0 then '[\"' || n_name || '\",\"\\\"\"]' end as text from nation",
)
