"""Queries over policy items. Each entry: the Spark query, and the same in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import items as I
from ..operators import sinks
from ..params import DEFAULT as P
from ..sources.fixtures import view, with_views

#: What the generated titles offer as words and groups.
WORDS, GROUPS = ("BUILDING", "MACHINERY"), ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD")
CATEGORIES = {"construction": ("BUILDING",), "industry": ("MACHINERY", "AUTOMOBILE"), "living": ("FURNITURE", "HOUSEHOLD")}
DAY = "date '1998-07-01'"
QUERIES = {}

JOINED = """
la as (select * from (select *, row_number() over (partition by policy_item_id order by created_on desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) rn from analyses) z where rn = 1),
j as (select i.*, coalesce(nullif(a.name, ''), nullif(i.agency_raw, '')) agency, coalesce(la.impact_level, '') impact
      from items i left join agencies a on i.agency_id = a.id left join la on i.id = la.policy_item_id),
r as (select *, case impact when 'high' then 4 when 'medium' then 3 when 'low' then 2 when 'none' then 1 else 0 end irank,
      case when impact not in ('none', '') and ((contains(title, 'AUTOMOBILE') or contains(title, 'FURNITURE') or contains(title, 'HOUSEHOLD'))
                or ((contains(title, 'BUILDING') or contains(title, 'MACHINERY')) and impact <> 'low') or impact = 'high') then 3
           when contains(title, 'AUTOMOBILE') or contains(title, 'FURNITURE') or contains(title, 'HOUSEHOLD') or impact in ('medium', 'low') then 2 else 1 end priority from j)
"""
DEADLINE = "notice_end asc nulls last, collected_on desc, id asc"
RECENT = "coalesce(notice_start, collected_on) desc, collected_on desc, id asc"


def _joined(spark, d):
    rows = I.joined(view(spark, d, "items"), view(spark, d, "agencies"), view(spark, d, "analyses"))
    return rows.withColumn("priority", I.priority(WORDS, GROUPS))


def _sql(body: str, *views: str) -> str:
    return with_views(f"with {JOINED} {body}", *(views or ("items", "agencies", "analyses")))


def _page(sort: str, **chosen):
    of_items = {k: v for k, v in chosen.items() if k in ("item_types", "statuses", "due", "text")}
    others = {k: v for k, v in chosen.items() if k not in of_items}

    def query(spark, d):
        items = I.chosen(view(spark, d, "items"), **of_items)  # what items alone decide comes before the joins
        join = I.joined_few if "due" in of_items else I.joined
        rows = join(items, view(spark, d, "agencies"), view(spark, d, "analyses")).withColumn("priority", I.priority(WORDS, GROUPS))
        rows = I.chosen(rows, **others)
        return I.page(rows, I.order_by(sort), 1, P.page_size).select("rank", "id", "item_type", "title", "agency", "impact", "notice_end", F.col("priority").cast("long").alias("priority"), "total")

    return query


def _page_sql(where: str, order: str) -> str:
    return _sql(f"select * from (select row_number() over (order by {order}) as rank, id, item_type, title, agency, impact, notice_end, priority::bigint as priority, count(*) over () as total from r where {where}) z where rank <= 9")


QUERIES["items_list_deadline"] = (_page("deadline", item_types=("bill", "legislation"), due=30), _page_sql(f"item_type in ('bill', 'legislation') and notice_end between {DAY} and {DAY} + 30", DEADLINE))
QUERIES["items_list_recent"] = (_page("recent", impacts=("high", ""), statuses=("O", "")), _page_sql("impact in ('high', '') and coalesce(status, '') in ('O', '')", RECENT))
QUERIES["items_list_impact"] = (_page("impact", due=14), _page_sql(f"notice_end between {DAY} and {DAY} + 14", f"irank desc, {DEADLINE}"))
QUERIES["items_list_priority"] = (
    _page("priority", text="BUILDING"),
    _sql(f"select t.rank, r.id, r.item_type, r.title, r.agency, r.impact, r.notice_end, r.priority::bigint as priority, (select count(*) from r where contains(title, 'BUILDING')) as total from r join (select id, row_number() over () as rank from (select id from r where contains(title, 'BUILDING') order by priority desc, {RECENT} limit 9) y) t on t.id = r.id"),
)
QUERIES["items_due_ignored"] = (_page("deadline", due=13), _page_sql("true", DEADLINE))
QUERIES["items_by_agency"] = (_page("deadline", agencies=("NATION_3", "NATION_7")), _page_sql("agency in ('NATION_3', 'NATION_7')", DEADLINE))
QUERIES["keyset_page"] = (
    lambda s, d: I.after_key(view(s, d, "items"), F.col("collected_on"), date(1998, 7, 1), 5000, 20).select("id", "collected_on"),
    with_views(f"select id, collected_on from items where collected_on < {DAY} or (collected_on = {DAY} and id < 5000) order by collected_on desc, id desc limit 20", "items"),
)
QUERIES["items_unanalysed"] = (
    lambda s, d: I.unanalysed(view(s, d, "items"), view(s, d, "analyses")).orderBy(F.col("notice_end").asc_nulls_last(), "id").limit(100).select("id", "notice_end"),
    with_views("select id, notice_end from items where not exists (select 1 from analyses a where a.policy_item_id = items.id) order by notice_end asc nulls last, id limit 100", "items", "analyses"),
)
QUERIES["items_without_marker"] = (
    lambda s, d: _joined(s, d).where(~F.col("impact").isin("", "none") & ~F.col("title").contains("STEEL")).orderBy(F.col("impact").isin("high", "medium").desc(), F.desc("collected_on"), "id").limit(50).select("id", "impact", "collected_on"),
    _sql("select id, impact, collected_on from r where impact not in ('', 'none') and not contains(title, 'STEEL') order by impact in ('high', 'medium') desc, collected_on desc, id limit 50"),
)
QUERIES["relink_agency"] = (
    lambda s, d: I.relinked(view(s, d, "items"), view(s, d, "agencies")).groupBy("agency_id").agg(F.count("*").alias("n")),
    with_views("select coalesce(agency_id, (select min(id) from agencies a where a.name = agency_raw)) as agency_id, count(*) as n from items group by 1", "items", "agencies"),
)
QUERIES["agency_by_name"] = (
    lambda s, d: I.named(view(s, d, "agencies").select(F.explode(F.array("name", "short_name", F.concat("name", F.lit("x")))).alias("q")), view(s, d, "agencies")),
    with_views("select q, (select min(id) from agencies b where b.name = q or b.short_name = q) as agency_id from (select unnest([name, short_name, name || 'x']) as q from agencies) z", "agencies"),
)
QUERIES["facet_agency"] = (
    lambda s, d: I.agency_facet(_joined(s, d).where("item_type = 'bill'"), view(s, d, "agencies"), "committee"),
    _sql("select agency, sum(n)::bigint as n from (select agency, count(*) n from r where item_type = 'bill' and agency is not null group by 1 union all select name, 0 from agencies where kind = 'committee' and enabled) z group by 1"),
)
QUERIES["facet_group"] = (
    lambda s, d: I.group_facet(view(s, d, "items"), (*GROUPS, "ABSENT")),
    with_views("select position, grp, (select count(*) from items where contains(title, grp)) as n from (select unnest([0, 1, 2, 3])::bigint as position, unnest(['AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD', 'ABSENT']) as grp) z", "items"),
)
QUERIES["facet_status"] = (lambda s, d: I.statuses(view(s, d, "items")), with_views("select distinct status from items where coalesce(status, '') <> ''", "items"))
QUERIES["facet_type"] = (lambda s, d: view(s, d, "items").groupBy("item_type").agg(F.count("*").alias("n")), with_views("select item_type, count(*) as n from items group by 1", "items"))
QUERIES["stats_totals"] = (
    lambda s, d: I.totals(view(s, d, "items"), view(s, d, "analyses")),
    with_views(f"select count(*) as total, count_if(notice_end >= {DAY})::bigint as open, count_if(id in (select policy_item_id from analyses))::bigint as analysed, max(collected_on) as last_collected from items", "items", "analyses"),
)
QUERIES["calendar_month"] = (
    lambda s, d: I.joined_few(I.calendar(view(s, d, "items"), "1998-07"), view(s, d, "agencies"), view(s, d, "analyses")).withColumn("priority", I.priority(WORDS, GROUPS)).orderBy(*I.calendar_order()).select("id", "notice_end", F.col("priority").cast("long").alias("priority")),
    _sql("select id, notice_end, priority::bigint as priority from r where notice_end >= date '1998-07-01' and notice_end < date '1998-08-01'"),
)
QUERIES["upcoming_15"] = (
    lambda s, d: _joined(s, d).where(F.col("notice_end") >= F.lit(P.as_of)).orderBy("notice_end", F.desc("priority"), F.coalesce("notice_start", "collected_on").desc(), "id").limit(P.upcoming).select("id", "notice_end"),
    _sql(f"select id, notice_end from r where notice_end >= {DAY} order by notice_end, priority desc, coalesce(notice_start, collected_on) desc, id limit 15"),
)
QUERIES["due_within_n"] = (
    lambda s, d: s.createDataFrame([(n,) for n in P.due_choices], "days int").join(view(s, d, "items").where(I.due_within(F.col("notice_end"), P.as_of, 30)).select(F.datediff("notice_end", F.lit(P.as_of)).alias("left")), F.col("left") <= F.col("days")).groupBy(F.col("days").cast("long").alias("days")).agg(F.count("*").alias("n")),
    with_views(f"select days::bigint as days, (select count(*) from items where notice_end between {DAY} and {DAY} + days) as n from (select unnest([7, 14, 30]) as days) z", "items"),
)
QUERIES["urgent"] = (
    lambda s, d: I.urgent(view(s, d, "items")).select("id", "notice_end", "status"),
    with_views(f"select id, notice_end, status from items where notice_end between {DAY} and {DAY} + 7 and coalesce(status, '') <> 'F'", "items"),
)
QUERIES["priority_tiers"] = (
    lambda s, d: _joined(s, d).withColumn("reason", I.priority_reason()).groupBy(F.col("priority").cast("long").alias("priority"), "reason").agg(F.count("*").alias("n")),
    _sql(f"select priority::bigint as priority, case when priority = 3 and notice_end between {DAY} and {DAY} + 14 then 'direct, imminent' when priority = 3 then 'direct' when priority = 2 then 'related' else 'other' end as reason, count(*) as n from r group by 1, 2"),
)
QUERIES["insert_or_skip"] = (
    lambda s, d: sinks.new_rows(view(s, d, "items").where("id % 3 <> 0").select("url_source"), view(s, d, "items").where("id % 2 = 0"), "url_source"),
    with_views("select distinct url_source from items where id % 3 <> 0 and url_source not in (select url_source from items where id % 2 = 0)", "items"),
)
QUERIES["seed_upsert"] = (
    lambda s, d: sinks.seeded(view(s, d, "agencies").where("id % 4 <> 0"), view(s, d, "agencies").where("id % 3 <> 0").withColumn("kind", F.lit("ministry")), "name", "kind"),
    with_views("select coalesce(a.name, b.name) as name, coalesce(b.kind, a.kind) as kind, a.name is null as inserted from (select name, kind from agencies where id % 4 <> 0) a full join (select name, 'ministry' as kind from agencies where id % 3 <> 0) b on a.name = b.name", "agencies"),
)
QUERIES["fill_null_deadline"] = (
    lambda s, d: sinks.filled(view(s, d, "items").select("id", "notice_end"), view(s, d, "items").where("id % 2 = 0").select("id", F.date_add("notice_start", 30).alias("notice_end")), "id", "notice_end"),
    with_views("select id, coalesce(notice_end, case when id % 2 = 0 then notice_start + 30 end) as notice_end from items", "items"),
)
QUERIES["cascade_delete"] = (
    lambda s, d: sinks.without(view(s, d, "analyses"), view(s, d, "items").where("status = 'F'").select(F.col("id").alias("policy_item_id")), "policy_item_id").groupBy("impact_level").agg(F.count("*").alias("n")),
    with_views("select impact_level, count(*) as n from analyses where policy_item_id not in (select id from items where status = 'F') group by 1", "items", "analyses"),
)
QUERIES["kv_last_write"] = (
    lambda s, d: sinks.last_write(view(s, d, "analyses"), "policy_item_id", "impact_level", "created_on", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"),
    _sql("select policy_item_id, impact_level from la"),
)
QUERIES["retention"] = (
    lambda s, d: sinks.kept_until(view(s, d, "items"), "collected_on", P.as_of, {"bill": 550, "grant_notice": 90}, "item_type").groupBy("item_type").agg(F.count("*").alias("n")),
    with_views(f"select item_type, count(*) as n from items where case item_type when 'bill' then date_diff('day', collected_on, {DAY}) <= 550 when 'grant_notice' then date_diff('day', collected_on, {DAY}) <= 90 else true end group by 1", "items"),
)
QUERIES["category_facets_cube"] = (
    lambda s, d: _joined(s, d).rollup("item_type", "impact").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level")),
    _sql("select item_type, impact, count(*) as n, grouping(item_type, impact)::bigint as level from r group by rollup(item_type, impact)"),
)

# --- the whole view ---------------------------------------------------------------------------------------------------

STAGE = "BRASS|BRUSHED"
VIEW = dict(interest=("cat1", "cat2"), direct_words=("ANODIZED", "PLATED"), focus="AUTOMOBILE", stages=STAGE, placeholder="no text yet", status_words=("O", "F", "P"))
FULL = ("items_full", "agencies", "analyses_full")
ALSO = ("summary", "impact_rationale", "affected_areas", "suggested_action", "model")
# DuckDB's patterns have no look-behind: a mark is put after each sentence's end, and texts are cut there
SENTENCES = "list_transform(list_filter(string_split_regex(regexp_replace(trim(coalesce(summary, '')), '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> ''), lambda s: trim(regexp_replace(s, '^[\\s\\-•·\\d.)]+([^\\s\\-•·\\d.)])', '\\1')))"
LIST = "coalesce(try_cast(case when json_valid({0}) then {0} end::json as varchar[]), [])"
FULL_SQL = f"""
la as (select * from (select *, row_number() over (partition by policy_item_id order by created_on desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) rn from analyses_full) z where rn = 1),
j as materialized (select i.*, nullif(a.name, '') as agency_name, coalesce(nullif(a.name, ''), nullif(i.agency_raw, '')) as agency_any, coalesce(la.impact_level, '') as impact, la.summary as summary, la.impact_rationale as rationale, la.suggested_action as action, la.affected_areas as areas, la.model as model
      from items_full i left join agencies a on i.agency_id = a.id left join la on i.id = la.policy_item_id),
v as (select *, {LIST.format("groups")} as gs, {LIST.format("attachments")} as files, {LIST.format("proposers")} as names, {SENTENCES} as sents, date_diff('day', {DAY}, notice_end) as dd,
      regexp_extract(title, '\\((홍길동)의원 등 (\\d+)인\\)', 1) as named, try_cast(regexp_extract(title, '\\((홍길동)의원 등 (\\d+)인\\)', 2) as bigint) as counted,
      case when contains(title, 'ANODIZED') then 'ANODIZED' when contains(title, 'PLATED') then 'PLATED' end as word from j),
w as (select *, list_contains(gs, 'AUTOMOBILE') as focused, list_filter(gs, lambda g: g <> 'AUTOMOBILE') as others, concat_ws(' ', title, coalesce(summary, ''), coalesce(rationale, ''), coalesce(law_name, ''), coalesce(status, '')) as texts from v),
u as (select *, impact <> 'none' and (focused or (word is not null and impact <> 'low') or impact = 'high') as direct,
      coalesce(case when dd between 0 and 14 then 'D-' || dd end, nullif(regexp_extract(texts, '{STAGE}'), '')) as stage from w),
t as (select *, case when direct then 3 when len(others) > 0 or impact in ('medium', 'low') or category in ('cat1', 'cat2') then 2 else 1 end as priority,
      case when direct then concat_ws(' + ', case when focused then 'focus group' when word is not null then 'title: ' || word else 'high impact' end, stage)
           when len(others) > 0 then 'groups: ' || array_to_string(others, ', ') when impact in ('medium', 'low') then 'impact: ' || impact when category in ('cat1', 'cat2') then 'category: ' || category else 'other' end as reason,
      case when starts_with(coalesce(summary, ''), 'no text yet') then ['제안이유·주요내용을 아직 확보하지 못했습니다 — 원문 링크에서 확인하세요'] else sents end as lines,
      list_filter(['대상 법령: ' || nullif(law_name, ''), coalesce('기간: ' || case when notice_start is not null or notice_end is not null then coalesce(notice_start::varchar, '미정') || ' ~ ' || coalesce(notice_end::varchar, '미정') end, '발표일: ' || published_at::varchar), '진행 상태: ' || nullif(status, ''), nullif(rationale, '')], lambda x: x is not null) as more from u),
o as materialized (select id, title, coalesce(nullif(url_canonical, ''), url_source) as url, item_type, category, coalesce(law_name, '') as law_name,
      coalesce(agency_name, case when agency_raw in ('O', 'F', 'P') or agency_raw is null or regexp_full_match(agency_raw, '[0-9\\s.\\-~/:()]*') then '' else agency_raw end) as agency, notice_start, notice_end, dd as d_day, coalesce(status, '') as status, coalesce(opinion_url, '') as opinion_url,
      case when item_type = 'trade_webzine' then '' else array_to_string(files, '|') end as attachments, case when item_type = 'trade_webzine' then coalesce(files[1], '') end as thumbnail, impact as impact_level, coalesce(summary, '') as stored, coalesce(rationale, '') as impact_rationale,
      array_to_string(list_filter(list_transform({LIST.format("areas")}, lambda x: trim(x)), lambda x: x <> ''), '|') as areas,
      case when action like 'do this%' then 'do this' when action = 'act only' then 'act only' else '' end as suggested_action,
      case when impact = 'none' or action is null or not contains(action, '[시사점] ') or action like '%] -' then '' else regexp_extract(action, '\\] (.*)$', 1) end as implication,
      array_to_string(gs, '|') as group_companies, published_at::varchar as published_at,
      case when item_type = 'bill' and len(names) = 0 and named <> '' then named else array_to_string(names, '|') end as proposers,
      case when item_type = 'bill' and named <> '' then greatest(len(names), greatest(counted, 1)) else len(names) end as proposer_total, priority::bigint as priority, reason as priority_reason,
      case when len(lines) > 3 then [lines[1], lines[2], array_to_string(lines[3:], ' ')] when len(lines) = 3 then lines
           when len(lines) = 0 then list_concat([title], more)[1:3] else list_concat(lines, list_filter(more, lambda m: not list_contains(lines, m)))[1:3] end as card, collected_on, gs from t)
"""
ALL = "id, title, url, item_type, category, law_name, agency, notice_start, notice_end, d_day, status, opinion_url, attachments, thumbnail, impact_level, summary, impact_rationale, areas, suggested_action, implication, group_companies, published_at, proposers, proposer_total, priority, priority_reason, summary_lines"


def _full(s, d, *names):
    return [view(s, d, n) for n in (names or FULL)]


def _viewed(s, d, items=None, few=False):
    all_items, agencies, analyses = _full(s, d)
    join = I.joined_few if few else I.joined
    return I.view(join(items if items is not None else all_items, agencies, analyses, *ALSO), **VIEW)


def _flat(rows):
    joined = lambda c: F.array_join(c, "|")
    rows = rows.withColumns({"attachments": joined("attachment_urls"), "areas": joined("affected_areas"), "group_companies": joined("group_companies"), "proposers": joined("proposers"), "summary_lines": joined("summary_lines"), "priority": F.col("priority").cast("long")})
    return rows.select(*ALL.split(", "))


def _full_sql(body, *views):
    return with_views(f"with {FULL_SQL} {body}", *(views or FULL))


CARD = ALL.replace(" summary,", " array_to_string(card, chr(10)) as summary,").replace("summary_lines", "array_to_string(card, '|') as summary_lines")
QUERIES["items_view"] = (lambda s, d: _flat(_viewed(s, d)), _full_sql(f"select {CARD} from o"))
QUERIES["item_detail"] = (lambda s, d: _flat(_viewed(s, d, view(s, d, "items_full").where("id = 77"), few=True)), _full_sql(f"select {CARD} from o where id = 77"))
QUERIES["items_search"] = (
    lambda s, d: I.page(I.view(I.chosen(I.joined(*_full(s, d), *ALSO), text="BRASS"), **VIEW), I.order_by("recent"), 1, P.page_size).select("rank", "id", "total"),
    _full_sql("select row_number() over () as rank, id, (select count(*) from o where contains(title, 'BRASS') or contains(law_name, 'BRASS') or contains(stored, 'BRASS')) as total from (select id from o where contains(title, 'BRASS') or contains(law_name, 'BRASS') or contains(stored, 'BRASS') order by coalesce(notice_start, collected_on) desc, collected_on desc, id limit 9) z"),
)
QUERIES["items_by_group"] = (
    lambda s, d: I.chosen(_viewed(s, d), groups=("MACHINERY", "FURNITURE")).groupBy("item_type").agg(F.count("*").alias("n"), F.min("id").alias("first")),
    _full_sql("select item_type, count(*) as n, min(id) as first from o where list_has_any(gs, ['MACHINERY', 'FURNITURE']) group by 1"),
)
QUERIES["items_by_priority"] = (
    lambda s, d: I.page(I.chosen(_viewed(s, d), priorities=(3,), due=14), I.order_by("priority"), 1, P.page_size).select("rank", "id", F.col("priority").cast("long").alias("priority"), "total"),
    _full_sql(f"select row_number() over () as rank, id, priority, (select count(*) from o where priority = 3 and notice_end between {DAY} and {DAY} + 14) as total from (select id, priority from o where priority = 3 and notice_end between {DAY} and {DAY} + 14 order by priority desc, coalesce(notice_start, collected_on) desc, collected_on desc, id limit 9) z"),
)
QUERIES["priority_reasons"] = (lambda s, d: _viewed(s, d).groupBy(F.col("priority").cast("long").alias("priority"), "priority_reason").agg(F.count("*").alias("n")), _full_sql("select priority, priority_reason, count(*) as n from o group by 1, 2"))
QUERIES["items_without_groups"] = (lambda s, d: I.without_groups(view(s, d, "items_full")).select("id"), with_views("select id from items_full where coalesce(groups, '') in ('', '[]')", "items_full"))
LATEST = "la as (select * from (select *, row_number() over (partition by policy_item_id order by created_on desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc) rn from analyses_full) z where rn = 1)"
QUERIES["items_placeholder"] = (
    lambda s, d: I.placeholders(*_full(s, d, "items_full", "analyses_full"), "no text", 50).select("id", "summary", "collected_on"),
    with_views(f"with {LATEST} select i.id, summary, collected_on from items_full i join la on la.policy_item_id = i.id where starts_with(summary, 'no text') order by collected_on desc, i.id limit 50", "items_full", "analyses_full"),
)
QUERIES["items_without_implication"] = (
    lambda s, d: I.without_implication(*_full(s, d, "items_full", "analyses_full"), 50).select("id", "impact"),
    with_views(f"with {LATEST} select i.id, impact_level as impact from items_full i join la on la.policy_item_id = i.id where not contains(coalesce(suggested_action, ''), '[시사점] ') and coalesce(model, '') <> 'rule' order by impact_level in ('high', 'medium') desc, collected_on desc, i.id limit 50", "items_full", "analyses_full"),
)
#: Titles of which some bills' summaries are echoes: one whole (its bracket doesn't count), one too short for its summary.
ECHOED = "case when item_type = 'bill' and id % 6 = 1 then 'ONE point (x)' when item_type = 'bill' and id % 6 = 2 then 'Line' else title end"
QUERIES["reanalysis_targets"] = (
    lambda s, d: I.to_reanalyse(view(s, d, "items_full").withColumn("title", F.expr(ECHOED)), view(s, d, "analyses_full"), "no text", 2000),
    with_views(f"with {LATEST}, k as (select *, lower(regexp_replace(regexp_replace({ECHOED}, '\\([^)]*\\)', '', 'g'), '[^A-Za-z0-9]+', '', 'g')) as t from items_full), c as (select k.*, summary, suggested_action, model, lower(regexp_replace(summary, '[^A-Za-z0-9]+', '', 'g')) as said from k join la on la.policy_item_id = k.id), y as (select *, case when item_type = 'bill' and t <> '' and contains(said, t) and length(said) <= 2.2 * length(t) then 1 when starts_with(summary, 'no text') then 2 when not contains(coalesce(suggested_action, ''), '[시사점] ') and coalesce(model, '') <> 'rule' then 3 end as why from c) select id, why::bigint as why from y where why is not null order by why, collected_on desc, id limit 2000", "items_full", "analyses_full"),
)
QUERIES["analysed_since"] = (lambda s, d: I.analysed_since(view(s, d, "analyses"), date(1998, 6, 1)), with_views("select count(*) as n from analyses where created_on >= date '1998-06-01'", "analyses"))
QUERIES["stats_excluded"] = (lambda s, d: I.excluded(view(s, d, "items").where("id % 9 = 0").select(F.concat(F.lit("u"), F.col("id") % 100).alias("url"))), with_views("select count(distinct id % 100) as excluded from items where id % 9 = 0", "items"))
QUERIES["urgent_head"] = (
    lambda s, d: I.urgent_head(view(s, d, "items")).select("id", "notice_end", "total"),
    with_views(f"select id, notice_end, (select count(*) from items where notice_end between {DAY} and {DAY} + 7 and coalesce(status, '') <> 'F') as total from (select * from items where notice_end between {DAY} and {DAY} + 7 and coalesce(status, '') <> 'F' order by notice_end, id limit 5) z", "items"),
)
QUERIES["calendar_malformed"] = (
    lambda s, d: I.calendar(view(s, d, "items"), "1998-13").agg(F.count("*").alias("n")),
    with_views("select count(*) as n from items where notice_end >= date '1998-07-01' and notice_end < date '1998-08-01'", "items"),
)
QUERIES["facet_agency_ordered"] = (
    lambda s, d: I.agency_facet(_joined(s, d), view(s, d, "agencies"), "ministry").orderBy(*I.facet_order()).limit(7),
    _sql("select * from (select agency, sum(n)::bigint as n from (select agency, count(*) n from r where agency is not null group by 1 union all select name, 0 from agencies where kind = 'ministry' and enabled) z group by 1) y order by n desc, agency limit 7"),
)
TYPES = {"bill": ("bill",), "notice": ("legislation", "admin_notice"), "policy": ("policy_press",), "grant": ("grant_notice",)}
QUERIES["facet_category"] = (
    lambda s, d: view(s, d, "items").select(I.category_of(TYPES).alias("category")).groupBy("category").agg(F.count("*").alias("n")),
    with_views("select case item_type when 'bill' then 'bill' when 'legislation' then 'notice' when 'admin_notice' then 'notice' when 'policy_press' then 'policy' else 'grant' end as category, count(*) as n from items group by 1", "items"),
)
