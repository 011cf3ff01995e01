"""Adapters: the logical views that the library works on, from the driver's tables. The same SQL makes the views of the
oracle, so both engines see the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "agencies": (("nation",), """
select cast(n_nationkey as bigint) id, n_name name, concat('N', cast(n_nationkey as varchar(9))) short_name,
 case when n_regionkey % 2 = 0 then 'ministry' else 'committee' end kind, n_nationkey % 10 <> 9 enabled from {nation}"""),
    "items": (("orders", "customer", "part"), """
select o.o_orderkey id, concat('ord://', cast(o.o_orderkey as varchar(20))) url_source,
 case substr(o.o_orderpriority,1,1) when '1' then 'bill' when '2' then 'legislation' when '3' then 'admin_notice' when '4' then 'policy_press' else 'grant_notice' end item_type,
 concat(p.p_name,' ',p.p_type,' ',c.c_mktsegment) title,
 case when o.o_custkey % 5 = 0 then null else cast(c.c_nationkey as bigint) end agency_id,
 case when o.o_custkey % 11 = 0 then null else concat('NATION_', cast(c.c_nationkey as varchar(9))) end agency_raw,
 cast(o.o_orderdate as date) notice_start,
 case when o.o_orderkey % 7 = 0 then null else cast(o.o_orderdate as date) + cast(o.o_orderkey % 60 as int) end notice_end,
 case when o.o_orderkey % 13 = 0 then null else o.o_orderstatus end status, cast(o.o_orderdate as date) collected_on
 from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {part} p on p.p_partkey = o.o_orderkey % (select count(*) from {part})"""),
    "analyses": (("lineitem",), """
select l_orderkey policy_item_id,
 case when l_returnflag='R' and l_linestatus='O' then 'high' when l_returnflag='R' then 'medium' when l_returnflag='A' then 'low' else 'none' end impact_level,
 cast(l_shipdate as date) created_on, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity from {lineitem}"""),
    "items_full": (("orders", "customer", "part"), """
select i.*, case when id % 3 = 0 then null when id % 3 = 1 then '' else concat('https://ex.org/i/', cast(id as varchar(20))) end url_canonical,
 case when id % 4 = 0 then null else part_type end law_name,
 case when id % 5 = 0 then concat('op://', cast(id as varchar(20))) end opinion_url,
 case id % 6 when 0 then null when 1 then '[]' when 2 then '["a.pdf","b.pdf"]' when 3 then 'broken[' else concat('["f', cast(id as varchar(20)), '.pdf"]') end attachments,
 case when id % 7 = 0 then null when id % 7 = 1 then '[]' when segment = 'AUTOMOBILE' and id % 2 = 0 then '["AUTOMOBILE","MACHINERY"]' else concat('["', segment, '"]') end groups,
 concat('cat', cast(id % 8 as varchar(9))) category, notice_start published_at,
 case when item_type <> 'bill' or id % 3 = 0 then null else '["Kim","Lee"]' end proposers
 from (select o.o_orderkey id, concat('ord://', cast(o.o_orderkey as varchar(20))) url_source,
 case when o.o_orderkey % 17 = 0 then 'trade_webzine' when substr(o.o_orderpriority,1,1) = '1' then 'bill' when substr(o.o_orderpriority,1,1) = '2' then 'legislation' when substr(o.o_orderpriority,1,1) = '3' then 'admin_notice' when substr(o.o_orderpriority,1,1) = '4' then 'policy_press' else 'grant_notice' end item_type,
 case when o.o_orderkey % 5 = 2 then concat(p.p_name,' ',p.p_type,' (홍길동의원 등 ', cast(o.o_orderkey % 20 as varchar(9)), '인)') else concat(p.p_name,' ',p.p_type,' ',c.c_mktsegment) end title,
 c.c_mktsegment segment, p.p_type part_type, case when o.o_custkey % 5 = 0 then null else cast(c.c_nationkey as bigint) end agency_id,
 case when o.o_custkey % 11 = 0 then null when o.o_custkey % 11 = 1 then 'O' when o.o_custkey % 11 = 2 then '12-3' else concat('NATION_', cast(c.c_nationkey as varchar(9))) end agency_raw,
 cast(o.o_orderdate as date) notice_start,
 case when o.o_orderkey % 7 = 0 then null else cast(o.o_orderdate as date) + cast(o.o_orderkey % 60 as int) end notice_end,
 case when o.o_orderkey % 13 = 0 then null else o.o_orderstatus end status, cast(o.o_orderdate as date) collected_on
 from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {part} p on p.p_partkey = o.o_orderkey % (select count(*) from {part})) i"""),
    "analyses_full": (("lineitem",), """
select l_orderkey policy_item_id,
 case when l_returnflag='R' and l_linestatus='O' then 'high' when l_returnflag='R' then 'medium' when l_returnflag='A' then 'low' else 'none' end impact_level,
 cast(l_shipdate as date) created_on, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
 case l_partkey % 5 when 0 then 'no text yet' when 1 then 'One point only.' when 2 then concat('- First of ', cast(l_partkey as varchar(20)), '. Second here! Third? Fourth. 2026 fifth.') when 3 then null else concat('Line A', chr(10), '* Line B', chr(10), 'Line A') end summary,
 case when l_suppkey % 3 = 0 then 'Article 3 applies' when l_suppkey % 3 = 1 then 'in general' else null end impact_rationale,
 case l_partkey % 4 when 0 then null when 1 then concat('do this', chr(10), '[시사점] watch ', cast(l_suppkey as varchar(20))) when 2 then '[시사점] -' else 'act only' end suggested_action,
 case l_partkey % 3 when 0 then '["x"," y ",""]' when 1 then 'bad' else null end affected_areas, case when l_suppkey % 4 = 0 then 'rule' else 'm1' end model from {lineitem}"""),
    "articles": (("documents", "labels"), """
select d.doc_id id, d.source press, d.lang category, d.text body, d.n_chars % 101 importance_score,
 date '2024-01-01' + cast((d.doc_id * 37) % 30 as int) published_on,
 case when l.doc_id is null then 'unrated' when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive' else 'neutral' end tone
 from {documents} d left join {labels} l on d.doc_id = l.doc_id"""),
    "articles_full": (("documents", "labels"), """
select a.*, case when id % 11 = 0 then null when id % 11 = 1 then ' ' else concat('rep', cast(id % 7 as varchar(9))) end author, case when id % 50 = 3 then 'manual' else 'feed' end source_type,
 case when id % 13 = 0 then 'pending' else 'active' end status, concat('https://', press, '.ex.org/', cast(id / 2 as bigint)) url, split_part(body, chr(10), 1) title,
 case id % 4 when 0 then array('A','B') when 1 then array('B') when 2 then array('C','A') else array('') end group_companies,
 case id % 3 when 0 then array('x','y') when 1 then array('y') else array('') end categories
 from (select d.doc_id id, d.source press, d.lang category, d.text body, d.n_chars % 101 importance_score,
 date '2024-01-01' + cast((d.doc_id * 37) % 30 as int) published_on,
 case when l.doc_id is null then 'unrated' when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive' else 'neutral' end tone
 from {documents} d left join {labels} l on d.doc_id = l.doc_id) a"""),
    "outlets": (("documents",), "select press, 1 + cast(substr(press,4,9) as int) % 3 tier from (select distinct source press from {documents}) z"),
    "queue": (("events",), "select event_id, user_id chat_id, event_type topic, ts, least(value, 100.0) score from {events}"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical view as a DataFrame."""
    tables, sql = VIEWS[name]
    return spark.sql(sql.replace("cast(id / 2 as bigint)", "id div 2").replace("varchar(9)", "string").replace("varchar(20)", "string"), **{t: table(spark, sf_dir, t) for t in tables})


def with_views(sql: str, *names: str) -> str:
    """The oracle's SQL with the views it needs."""
    made = ", ".join(f"{n} as ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names)
    made = made.replace("array(", "list_value(").replace("cast(id / 2 as bigint)", "(id // 2)")
    body = sql.strip()
    return f"with {made}, {body[5:]}" if body[:5].lower() == "with " else f"with {made} {body}"
