"""Queries over articles, outlets and their duplicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bills
from ..functions import text as X
from ..operators import articles as A
from ..operators import dedup, items, rules, running_clusters, scorer, sinks, stats
from ..operators.components import components
from ..operators.vector_links import near_vector_links
from ..params import DEFAULT as P
from ..sources.fixtures import table, view, with_views
from ..storage import written

AS_OF = date(2024, 1, 31)
ITEMS_AS_OF = date(1998, 7, 1)
QUERIES = {}
LANGS = {"english": (" the ", " and "), "german": (" der ", " und "), "french": (" les ", " des ")}
RULES = (rules.Rule("opening", 50, ("The ", "Das "), "title"), rules.Rule("tion", 25, ("tion",), "body"), rules.Rule("licence", 20, ("Licensed",)), rules.Rule("noise", -15, ("%%%", "$$$")))


def _title():
    return F.split_part("body", F.lit("\n"), F.lit(1))


def _sql(sql, *views):
    return with_views(sql, *(views or ("articles",)))


def _articles(s, d):
    return view(s, d, "articles")


QUERIES["article_list"] = (
    lambda s, d: _articles(s, d).where("importance_score between 20 and 80 and tone in ('positive', 'neutral') and category = 'en'").where(F.datediff(F.lit(AS_OF), "published_on") <= 30).orderBy(F.desc("published_on"), F.desc("importance_score"), "id").limit(20).select("id", "press", "published_on", F.col("importance_score").cast("long").alias("score")),
    _sql("select id, press, published_on, importance_score::bigint as score from articles where importance_score between 20 and 80 and tone in ('positive', 'neutral') and category = 'en' and date_diff('day', published_on, date '2024-01-31') <= 30 order by published_on desc, importance_score desc, id limit 20"),
)
QUERIES["score_range"] = (lambda s, d: _articles(s, d).agg(F.min("importance_score").alias("low"), F.max("importance_score").alias("high")), _sql("select min(importance_score) as low, max(importance_score) as high from articles"))
QUERIES["relevance_filter"] = (
    lambda s, d: _articles(s, d).where(rules.has_any(F.col("body"), (" the ", " der "))).groupBy("category").agg(F.count("*").alias("n")),
    _sql("select category, count(*) as n from articles where contains(body, ' the ') or contains(body, ' der ') group by 1"),
)
QUERIES["category_first_match"] = (
    lambda s, d: _articles(s, d).groupBy(rules.first_category(F.col("body"), LANGS).alias("label")).agg(F.count("*").alias("n")),
    _sql("select case when contains(body, ' the ') or contains(body, ' and ') then 'english' when contains(body, ' der ') or contains(body, ' und ') then 'german' when contains(body, ' les ') or contains(body, ' des ') then 'french' else 'other' end as label, count(*) as n from articles group by 1"),
)
QUERIES["groups_all_match"] = (
    lambda s, d: _articles(s, d).groupBy(F.array_join(rules.all_categories(F.col("body"), LANGS), ",").alias("labels")).agg(F.count("*").alias("n")),
    _sql("select concat_ws(',', case when contains(body, ' the ') or contains(body, ' and ') then 'english' end, case when contains(body, ' der ') or contains(body, ' und ') then 'german' end, case when contains(body, ' les ') or contains(body, ' des ') then 'french' end) as labels, count(*) as n from articles group by 1"),
)
PARTS = """p as (select id, case when contains(split_part(body, chr(10), 1), 'The ') or contains(split_part(body, chr(10), 1), 'Das ') then 50 else 0 end a,
 case when contains(body, 'tion') then 25 else 0 end b, case when contains(body, 'Licensed') then 20 else 0 end c, case when contains(body, '%%%') or contains(body, '$$$') then -15 else 0 end e from articles)"""


def _parts(s, d, which=RULES):
    return _articles(s, d).select("id", rules.contributions(_title(), F.col("body"), which).alias("parts"))


QUERIES["importance_score"] = (lambda s, d: _parts(s, d).select("id", rules.clamped(F.col("parts")).alias("score")), _sql(f"with {PARTS} select id, greatest(0, least(100, a + b + c + e))::bigint as score from p"))
QUERIES["score_breakdown"] = (
    lambda s, d: _parts(s, d).select(F.explode("parts").alias("x")).groupBy(F.col("x.label").alias("label")).agg(F.count("*").alias("n"), F.sum("x.points").alias("points")),
    _sql(f"with {PARTS} select label, count(*) as n, sum(points)::bigint as points from (select unnest(['opening', 'tion', 'licence', 'noise']) as label, unnest([a, b, c, e]) as points from p) z where points <> 0 group by 1"),
)
OVERRIDDEN = (rules.Rule("opening", 10, ("The ", "Das "), "title"), rules.Rule("tion", 25, ("tion",), "body", enabled=False), *RULES[2:])
QUERIES["score_overrides"] = (lambda s, d: _parts(s, d, OVERRIDDEN).select("id", rules.clamped(F.col("parts")).alias("score")), _sql(f"with {PARTS} select id, greatest(0, least(100, a / 5 + c + e))::bigint as score from p"))
QUERIES["outlet_stats"] = (
    lambda s, d: stats.outlet_stats(_articles(s, d), AS_OF),
    _sql("select press, count_if(age < 7)::bigint as d7, count_if(age < 30)::bigint as d30, count_if(age < 365)::bigint as d365, count_if(tone = 'positive')::bigint as positive, count_if(tone = 'neutral')::bigint as neutral, count_if(tone = 'negative')::bigint as negative, count_if(tone = 'unrated')::bigint as unrated from (select *, date_diff('day', published_on, date '2024-01-31') as age from articles) z group by 1"),
)
QUERIES["outlet_tone_colour"] = (
    lambda s, d: stats.outlet_stats(_articles(s, d), AS_OF).select("press", stats.colour(F.col("positive"), F.col("negative")).alias("colour")),
    _sql("select press, case when p + n = 0 then 'none' when abs(p - n) / (p + n) <= 0.6 then 'neutral' when p > n then 'positive' else 'negative' end as colour from (select press, count_if(tone = 'positive') as p, count_if(tone = 'negative') as n from articles group by 1) z"),
)
QUERIES["outlet_rank"] = (
    lambda s, d: stats.ranked(stats.outlet_stats(_articles(s, d), AS_OF)).select("press", "rank"),
    _sql("select press, rank() over (order by y desc, m desc, w desc) as rank from (select press, count_if(age < 7) as w, count_if(age < 30) as m, count_if(age < 365) as y from (select *, date_diff('day', published_on, date '2024-01-31') as age from articles) q group by 1) z"),
)
QUERIES["dup_exact_hash"] = (lambda s, d: dedup.same_text(_articles(s, d)), _sql("select sha256(body) as digest, count(*) as n, min(id) as first from articles group by 1 having count(*) > 1"))
QUERIES["dup_representative"] = (
    lambda s, d: dedup.representatives(_articles(s, d), view(s, d, "outlets"), F.sha2("body", 256)),
    _sql("select grp, id, members from (select sha256(body) as grp, id, count(*) over (partition by sha256(body)) as members, row_number() over (partition by sha256(body) order by coalesce(tier, 9), coalesce(body, '') = '', published_on, id) as rn from articles left join outlets using (press)) z where rn = 1", "articles", "outlets"),
)
# Titles of all articles, whole first lines. The SQL compares each two of near days and like lengths, which is slow on
# large tables.
TITLE_PAIRS = """t as (select id, published_on as day, lower(regexp_replace(regexp_replace(regexp_replace(split_part(body, chr(10), 1), '\\[[^\\]]*\\]|\\([^)]*\\)', ' ', 'g'), '\\s+[-|]\\s+[^-|]{1,30}$', ''), '[^\\p{L}\\p{N}]+', '', 'g')) as k from articles where body is not null),
g as (select id, day, list_distinct(case when length(k) < 3 then [k] else list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3)) end) as g from t),
p as (select x.id as a, y.id as b, len(list_intersect(x.g, y.g)) as n, len(x.g) as nx, len(y.g) as ny from g x join g y on x.id < y.id and abs(date_diff('day', x.day, y.day)) <= 1 and len(x.g) >= 0.9 * len(y.g) and len(y.g) >= 0.9 * len(x.g)),
tp as (select a, b, round(n / (nx + ny - n), 6) as similarity from p where n / (nx + ny - n) >= 0.9)"""
QUERIES["dup_title_blocked"] = QUERIES["dup_title_all"] = (
    lambda s, d: dedup.near_titles(_articles(s, d).select("id", _title().alias("title"), F.col("published_on").alias("day")), P.title_ratio, P.title_days).select("a", "b", F.round("similarity", 6).alias("similarity")),
    _sql(f"with {TITLE_PAIRS} select a, b, similarity from tp"),
)
VECTOR_DAY = "date '2024-01-01' + cast((vec_id * 37) % 30 as int)"
# The tables' vectors are nowhere as near as the default asks, so these queries take a lower threshold.
LEAST = 0.35
VECTOR_PAIRS = f"e as (select vec_id, embedding::double[] as v, {VECTOR_DAY} as day from embeddings), vp as (select x.vec_id as a, y.vec_id as b, list_cosine_similarity(x.v, y.v) as c from e x join e y on x.vec_id < y.vec_id and abs(date_diff('day', x.day, y.day)) <= 1)"
QUERIES["dup_vector"] = QUERIES["dup_vector_days"] = (
    lambda s, d: dedup.near_vectors_within(table(s, d, "embeddings").select("vec_id", "embedding", F.expr(VECTOR_DAY).alias("day")), LEAST, 1, id_col="vec_id").select("a", "b", F.round("similarity", 6).alias("similarity")),
    f"with {VECTOR_PAIRS} select a, b, round(c, 6) as similarity from vp where c >= {LEAST}",
)


def _cluster_links(s, d):
    rows = view(s, d, "articles_full")
    titles = dedup.title_links(rows.select("id", "title", F.col("published_on").alias("day")), P.title_ratio, P.title_days)
    vectors = dedup.vector_links(table(s, d, "embeddings").select("vec_id", "embedding", F.expr(VECTOR_DAY).alias("day")), LEAST, 1, id_col="vec_id")
    return rows, dedup.same_links(rows, X.normal_url(F.col("url"))).unionByName(dedup.same_links(rows, F.sha2("body", 256))).unionByName(titles).unionByName(vectors)


def dup_clusters(s, d):
    """Groups by url, text, title and vector links together, a representative each, and its aliases."""
    rows, links = _cluster_links(s, d)
    some = F.substring("body", 1, 1).alias("body")  # whether there is one decides; whole bodies would go through each join
    done = dedup.clusters(rows.select("id", "press", "published_on", some, "url"), links, view(s, d, "outlets"))
    return done.select("id", "grp", "is_representative", F.array_join("aliases", " ").alias("aliases"))


QUERIES["dup_clusters"] = (
    dup_clusters,
    _sql(
        f"""with {TITLE_PAIRS}, {VECTOR_PAIRS},
l as (select id as a, min(id) over (partition by url) as b from articles_full union all select id, min(id) over (partition by body) from articles_full where body is not null union all select a, b from tp union all select a, b from vp where c >= {LEAST}),
both_ways as (select a, b from l where a <> b union select b, a from l where a <> b),
r as (select id as node, id as other from articles_full union select r.node, w.b from r join both_ways w on r.other = w.a),
c as (select node as id, min(other) as grp from r where node in (select id from articles_full) group by 1),
m as (select f.id, c.grp, f.url, row_number() over (partition by c.grp order by coalesce(o.tier, 9), coalesce(body, '') = '', published_on, f.id) as rn from articles_full f join c on c.id = f.id left join outlets o on o.press = f.press)
select id, grp, rn = 1 as is_representative, case when rn = 1 then coalesce((select string_agg(distinct x.url, ' ' order by x.url) from m x where x.grp = m.grp and x.rn > 1), '') else '' end as aliases from m""",
        "articles", "articles_full", "outlets",
    ).replace("with ", "with recursive ", 1),
)
def _altered(s, d):
    """The tables' vectors and altered copies of some, of which a part is near enough for the default threshold."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.expr(VECTOR_DAY).alias("day"))
    more = rows.where("id % 3 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).where("k = 1 or id % 9 = 0")
    noise = lambda x, i: x * (1 + F.lit(0.13) * F.pmod(F.col("of") * 7 + (i + 1) * (i + 2) * F.col("k"), F.lit(11)) - 0.65)
    return rows.unionByName(more.withColumnRenamed("id", "of").select((F.col("of") + 1000000 * F.col("k")).alias("id"), F.transform("v", noise).alias("v"), F.date_add("day", "k").alias("day")))


def dup_vector_groups(s, d):
    """Every vector with the group that near vectors form."""
    rows = _altered(s, d)
    groups = components(near_vector_links(rows, P.cosine, P.title_days, vector="v"))
    return rows.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("grp"))


QUERIES["dup_vector_groups"] = (
    dup_vector_groups,
    f"""with recursive base as (select vec_id as id, embedding::double[] as v, {VECTOR_DAY} as day from embeddings),
w as (select * from base union all select id + 1000000 * k, list_transform(v, lambda x, i: x * (1 + 0.13 * ((id * 7 + i * (i + 1) * k) % 11) - 0.65)), day + k from (select *, unnest([1, 2]) as k from base) z where id % 3 = 0 and (k = 1 or id % 9 = 0)),
near as (select x.id as a, y.id as b from w x join w y on x.id < y.id and abs(date_diff('day', x.day, y.day)) <= {P.title_days} where list_cosine_similarity(x.v, y.v) >= {P.cosine}),
both_ways as (select a, b from near union select b, a from near),
r as (select id as node, id as other from w union select r.node, n.b from r join both_ways n on r.other = n.a)
select node as id, min(other) as grp from r group by 1""",
)


def dup_clusters_by_run(s, d):
    """The clusters after five runs, each with a fifth of the articles and the links among them and to older ones."""
    rows, links = _cluster_links(s, d)
    rows, links = rows.select("id", "press", "published_on", "body", "url"), written(links.select("a", "b"), "cluster-links")
    labels = None
    for run in range(5):
        new = running_clusters.of_articles(rows.where(F.col("id") % 5 == run), view(s, d, "outlets"))
        labels = running_clusters.extended(labels, new, links.where(F.greatest(F.col("a") % 5, F.col("b") % 5) == run))
    return running_clusters.with_aliases(labels).select("id", "grp", "is_representative", F.array_join("aliases", " ").alias("aliases"))


QUERIES["dup_clusters_by_run"] = (dup_clusters_by_run, QUERIES["dup_clusters"][1])
QUERIES["dup_url"] = (
    lambda s, d: dedup.same_links(view(s, d, "articles_full"), X.normal_url(F.col("url"))),
    _sql("select id as a, b from (select id, min(id) over (partition by url) as b from articles_full) z where id <> b", "articles_full"),
)


def _best_cosine(s, d):
    """id and similarity of vectors that another of a neighbouring day is like."""
    pairs = dedup.near_vectors_within(table(s, d, "embeddings").select("vec_id", "embedding", F.expr(VECTOR_DAY).alias("day")), LEAST, 1, id_col="vec_id")
    return pairs.select(F.explode(F.array("a", "b")).alias("id"), "similarity").groupBy("id").agg(F.max("similarity").alias("similarity"))


QUERIES["dup_residual"] = (
    lambda s, d: dedup.residual(view(s, d, "articles_full"), dedup.same_links(view(s, d, "articles_full"), F.sha2("body", 256)), _best_cosine(s, d), P.embeddings_a_run, LEAST, [F.desc("published_on"), F.col("id")]).select("id"),
    _sql(
        f"with {VECTOR_PAIRS}, l as (select id, min(id) over (partition by body) as b, count(*) over (partition by body) as n from articles_full where body is not null) select id from articles_full where id not in (select id from l where n > 1) and id in (select unnest([a, b]) from vp where c >= {LEAST}) order by published_on desc, id limit {P.embeddings_a_run}",
        "articles_full",
    ),
)
QUERIES["news_merge"] = (
    lambda s, d: stats.merged_news(_articles(s, d), view(s, d, "items"), "en", 120),
    _sql("select kind, id, day from (select 'article' as kind, id, published_on as day from articles where category = 'en' union all select 'item', id, collected_on from items) z order by day desc, kind, id limit 120", "articles", "items"),
)
QUERIES["weekly_report"] = (
    lambda s, d: A.weekly(_articles(s, d), view(s, d, "items"), AS_OF, ITEMS_AS_OF),
    _sql("""select 'articles' as kind, category as part, tone as of, count(*) as n, round(avg(importance_score), 4) as mean_score from articles where date_diff('day', published_on, date '2024-01-31') between 1 and 7 group by 2, 3
union all select 'items', item_type, '', least(count(*), 120), null from items where date_diff('day', collected_on, date '1998-07-01') between 1 and 7 group by 2""", "articles", "items"),
)
QUERIES["roster_party"] = (
    lambda s, d: stats.party_of(_articles(s, d).select(F.col("press").alias("name"), F.when(F.regexp_extract("press", r"\d+", 0).cast("int") % 2 == 0, "even").otherwise(F.col("category")).alias("party"))),
    _sql("select press as name, case when count(distinct party) > 1 then '' else min(party) end as party from (select press, case when substr(press, 4)::int % 2 = 0 then 'even' else category end as party from articles) z group by 1"),
)
QUERIES["text_collapse"] = (
    lambda s, d: _articles(s, d).select("id", F.sha2(X.collapsed(F.col("body")), 256).alias("digest")),
    _sql("select id, sha256(trim(regexp_replace(body, '[\\s\\x{85}\\x{A0}\\x{3000}\\x{2000}-\\x{200A}\\x0B]+', ' ', 'g'))) as digest from articles"),
)
QUERIES["title_normal_form"] = QUERIES["title_whole_form"] = (
    lambda s, d: _articles(s, d).select("id", X.normal_form(_title()).alias("k")),
    _sql("select id, lower(regexp_replace(split_part(body, chr(10), 1), '[^\\p{L}\\p{N}]+', '', 'g')) as k from articles"),
)
QUERIES["group_facet_articles"] = (
    lambda s, d: _articles(s, d).select(F.explode(items.matching_groups(F.col("body"), ("idiot", "Licensed", "token"))).alias("grp")).groupBy("grp").agg(F.count("*").alias("n")),
    _sql("select grp, count(*) as n from (select unnest(['idiot', 'Licensed', 'token']) as grp, body from articles) z where contains(body, grp) group by 1"),
)

# --- lists and dashboards ----------------------------------------------------------------------------------------------

FULL = "articles_full"


def _full(s, d):
    return view(s, d, FULL)


QUERIES["articles_filtered"] = (
    lambda s, d: A.chosen(_full(s, d), AS_OF, groups=("A", "C"), outlets=("src1", "src2", "src3", "src5"), tones=("positive", "unrated"), low="90", high="20", period="30d", author="rep").orderBy(*A.order_by("score")).limit(9).select("id", "press", "author", F.col("importance_score").cast("long").alias("score")),
    _sql("select id, press, author, importance_score::bigint as score from articles_full where list_has_any(group_companies, ['A', 'C']) and press in ('src1', 'src2', 'src3', 'src5') and tone in ('positive', 'unrated') and importance_score between 20 and 90 and date_diff('day', published_on, date '2024-01-31') between 0 and 29 and contains(author, 'rep') order by source_type = 'manual' desc, importance_score desc, published_on desc, id desc limit 9", FULL),
)
QUERIES["articles_search"] = (
    lambda s, d: A.chosen(_full(s, d), AS_OF, text="tion", body="der", low=0, high="abc", period="all").agg(F.count("*").alias("n"), F.min("id").alias("first")),
    _sql("select count(*) as n, min(id) as first from articles_full where (contains(title, 'tion') or contains(body, 'tion')) and contains(body, 'der')", FULL),
)
QUERIES["article_history"] = (
    lambda s, d: A.history(_full(s, d), "y", AS_OF).select("id", "published_on"),
    _sql("select id, published_on from articles_full where date_diff('day', published_on, date '2024-01-31') between 0 and 45 and list_contains(categories, 'y') order by published_on desc, id desc limit 400", FULL),
)
QUERIES["articles_visible"] = (
    lambda s, d: A.visible(_full(s, d), view(s, d, "outlets").withColumn("status", F.when(F.col("tier") < 3, "approved").otherwise("pending"))).groupBy("press").agg(F.count("*").alias("n")),
    _sql("select press, count(*) as n from articles_full where status = 'active' and press in (select press from outlets where tier < 3) group by 1", FULL, "outlets"),
)
QUERIES["dashboard_totals"] = (
    lambda s, d: A.dashboard(_articles(s, d), view(s, d, "queue").withColumn("state", F.when(F.col("topic") == "error", "failed")), view(s, d, "queue").where("topic = 'view'"), date(2024, 1, 30)),
    _sql("select count(*) as total, count_if(published_on = date '2024-01-30')::bigint as today, max(published_on) as last_collected, count_if(tone = 'unrated')::bigint as analysis_pending, (select count(*) from queue where topic = 'error') as notify_failed, (select count(*) from queue where topic = 'view') as log_total from articles", "articles", "queue"),
)
QUERIES["analysis_pending"] = (
    lambda s, d: A.drill_down(_articles(s, d).withColumn("day", F.col("published_on")), "tone", "unrated", 30).select("id", "day"),
    _sql("select id, published_on as day from articles where tone = 'unrated' order by published_on desc, id desc limit 30"),
)
QUERIES["outlet_reporters"] = (
    lambda s, d: A.reporters(_full(s, d), AS_OF),
    _sql("select press, author, n, positive, negative, row_number() over (partition by press order by n desc, author) as place from (select press, author, count(*) as n, count_if(tone = 'positive')::bigint as positive, count_if(tone = 'negative')::bigint as negative from articles_full where date_diff('day', published_on, date '2024-01-31') between 0 and 364 and trim(coalesce(author, '')) <> '' group by 1, 2) z", FULL),
)
QUERIES["articles_in_turns"] = (
    lambda s, d: A.in_turns(_full(s, d), "group_companies", [F.desc("importance_score"), F.col("id")], 25).select("id", "company", F.col("turn").cast("long").alias("turn")),
    _sql("select id, company, turn from (select id, company, row_number() over (partition by company order by importance_score desc, id) as turn from (select *, coalesce(group_companies[1], '') as company from articles_full) z) y order by turn, company, id limit 25", FULL),
)
QUERIES["article_bodies"] = (
    lambda s, d: A.bodies(_full(s, d).select("id", "url"), _full(s, d).where("id % 3 = 0").select("url", "body"), "url").select("id", F.char_length("body").cast("long").alias("n")),
    _sql("with b as (select url, max(length(body)) as n from articles_full where id % 3 = 0 group by 1) select id, coalesce(b.n, 0) as n from articles_full a left join b on a.url = b.url", FULL),
)
QUERIES["feed_keywords"] = (
    lambda s, d: A.matching(_articles(s, d), ("Licensed", "und", "tion"), "body").groupBy("matched").agg(F.count("*").alias("n")),
    _sql("select case when contains(body, 'Licensed') then 'Licensed' when contains(body, 'und') then 'und' else 'tion' end as matched, count(*) as n from articles where contains(body, 'Licensed') or contains(body, 'und') or contains(body, 'tion') group by 1"),
)
QUERIES["groups_normal"] = (
    lambda s, d: _full(s, d).select("id", F.array_join(rules.normal_groups(F.col("group_companies"), {"A": ("B", "C"), "D": ()}), ",").alias("groups"), F.array_join(rules.normal_keywords(F.array(F.lit("B"), F.lit(" k1 "), F.col("press"), F.lit(""), F.lit("k1")), F.col("group_companies")), ",").alias("keywords")),
    _sql("select id, case id % 4 when 0 then 'B' when 1 then 'B' when 2 then 'C' else '' end as groups, case when id % 4 in (0, 1) then '' else 'B,' end || 'k1,' || press as keywords from articles_full", FULL),
)
SCORER = scorer.rule_scorer(RULES, {"positive": ("tion",), "negative": ("idiot",)}, {"english": (" the ",), "german": (" der ",)}, ("Licensed",))
QUERIES["scored_groups"] = (
    lambda s, d: scorer.judged(_full(s, d).withColumn("grp", F.sha2("body", 256)).withColumn("is_representative", F.row_number().over(Window.partitionBy("grp").orderBy("id")) == 1), SCORER).select("id", F.col("judgement.score").alias("score"), F.col("judgement.tone").alias("tone"), F.array_join("judgement.groups", ",").alias("groups")),
    _sql(f"with {PARTS.replace('from articles)', 'from articles_full)')} select p.id, greatest(0, least(100, a + b + c + e))::bigint as score, case when contains(body, 'tion') then 'positive' when contains(body, 'idiot') then 'negative' else 'neutral' end as tone, concat_ws(',', case when contains(body, ' the ') then 'english' end, case when contains(body, ' der ') then 'german' end) as groups from p join articles_full using (id)", FULL),
)


def _stub(rows: list[dict]) -> list[str]:
    """A model that fails with every batch that holds a seventh id, and always with a fourteenth."""
    if any(r["id"] % 14 == 0 for r in rows) or (len(rows) > 1 and any(r["id"] % 7 == 0 for r in rows)):
        raise RuntimeError("no answer")
    return [f"of {r['title'][:30]}: {len(r['text'])}" for r in rows]


def summaries_within_budget(s, d):
    """One row a text, the most important first; of some there is no body."""
    rows = _full(s, d).groupBy(F.sha2(F.coalesce("body", F.lit("")), 256)).agg(F.min_by(F.struct("id", "body", "importance_score"), "id").alias("x")).select("x.*")
    rows = rows.select("id", F.translate(F.substring(F.coalesce("body", F.lit("")), 1, 40), "\n\r\t", "   ").alias("title"), F.when(F.col("id") % 3 != 0, F.col("body")).alias("body"), F.lit("more").alias("description"), "importance_score")
    return scorer.budgeted(rows, _stub, P.daily_calls, [F.desc("importance_score"), F.col("id")])


QUERIES["summaries_within_budget"] = (
    summaries_within_budget,
    _sql(
        f"""with r as (select min(id) as id from articles_full group by sha256(coalesce(body, ''))),
t as (select id, translate(substr(coalesce(body, ''), 1, 40), chr(10) || chr(13) || chr(9), '   ') as title, case when id % 3 <> 0 then coalesce(body, '') else '' end as body, importance_score, row_number() over (order by importance_score desc, id) as n from articles_full where id in (select id from r)),
x as (select *, trim(body, ' ') <> '' as whole, trim(concat_ws(chr(10), nullif(title, ''), 'more'), ' ') as snippet from t)
select id, case when n > {P.daily_calls} then 'waiting' when id % 14 = 0 then 'fallback' when whole then 'model' else 'snippet' end as path,
       case when n > {P.daily_calls} then null when id % 14 = 0 then snippet else trim('of ' || substr(title, 1, 30) || ': ' || length(case when whole then body else snippet end)) end as summary from x""",
        "articles_full",
    ),
)
QUERIES["tone_fallback"] = (
    lambda s, d: _articles(s, d).groupBy(rules.sane_tone(F.col("tone")).alias("tone")).agg(F.count("*").alias("n")),
    _sql("select case when tone in ('positive', 'negative') then tone else 'neutral' end as tone, count(*) as n from articles group by 1"),
)
QUERIES["summary_lines"] = (
    lambda s, d: _articles(s, d).select("id", bills.summary_header(F.col("press"), F.when(F.col("id") % 2 == 0, F.col("category"))).alias("header"), F.md5(F.array_join(X.three_lines(F.col("body")), "|")).alias("lines")),
    _sql("select id, '[' || press || case when id % 2 = 0 then ', ' || category else '' end || ']' as header, md5(array_to_string(case when len(l) > 3 then [l[1], l[2], array_to_string(l[3:], ' ')] else l end, '|')) as lines from (select *, list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), '([.!?。])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^[\\s\\-•·\\d.)]+([^\\s\\-•·\\d.)])', '\\1'), '^([\\s\\-•·\\d.)]+)$', '\\1'), '^\\s+|\\s+$', '', 'g')) as l from articles) z"),
)
QUERIES["bodies_kept"] = (
    lambda s, d: sinks.without_old_bodies(_articles(s, d), "published_on", F.col("tone") != "unrated", date(2024, 2, 14), P.body_days).groupBy("category").agg(F.count("*").alias("n"), F.count("body").alias("with_body")),
    _sql("select category, count(*) as n, count(case when tone = 'unrated' and date_diff('day', published_on, date '2024-02-14') <= 30 then body end) as with_body from articles group by 1"),
)
QUERIES["prefix_caps"] = (
    lambda s, d: _articles(s, d).select("id", *[F.char_length(X.capped(F.col("body"), n)).cast("long").alias(c) for c, n in (("probe", P.probe), ("prompt", P.prompt), ("notice", P.notice), ("detail", P.detail))]),
    _sql("select id, length(substr(body, 1, 2000)) as probe, length(substr(body, 1, 6000)) as prompt, length(substr(body, 1, 4000)) as notice, length(substr(body, 1, 8000)) as detail from articles"),
)
QUERIES["news_by_agency"] = (
    lambda s, d: stats.merged_news(_articles(s, d).withColumn("agency", F.concat(F.lit("NATION_"), F.col("id") % 25)), view(s, d, "items").withColumnRenamed("agency_raw", "agency"), "en", 500, "NATION_3"),
    _sql("select kind, id, day from (select 'article' as kind, id, published_on as day from articles where category = 'en' and id % 25 = 3 union all select 'item', id, collected_on from items where agency_raw = 'NATION_3') z order by day desc, kind, id limit 120", "articles", "items"),
)
