"""Articles: filters, orders, the history, and what dashboards and reports count."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import DEFAULT, Params

PERIODS = {"today": 0, "7d": 6, "30d": 29}
#: The fields of the advanced search and the columns that they look at.
ADVANCED = {"title": "title", "body": "body", "press": "press", "author": "author"}


def score_bounds(low: object, high: object) -> tuple[int, int]:
    """Whole bounds within 0 and 100, where 0 is no bound, as is what is no number; the wrong way round they are swapped."""

    def bound(x: object) -> int:
        try:
            return max(0, min(100, int(float(str(x).strip() or 0) // 1)))
        except (ValueError, OverflowError):
            return 0

    a, b = bound(low), bound(high)
    return (b, a) if a and b and a > b else (a, b)


def chosen(rows: DataFrame, as_of: date, groups=(), categories=(), outlets=(), tones=(), low: object = 0, high: object = 0, period: str = "all", text: str = "", **advanced: str) -> DataFrame:
    """Any value inside a facet, every facet together. period: today, 7d, 30d or all; text: in title or body; advanced:
    title, body, press, author, each a part that its field must hold."""
    for column, wanted in (("category", categories), ("press", outlets), ("tone", tones)):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    if groups:
        rows = rows.where(F.arrays_overlap("group_companies", F.array(*map(F.lit, groups))))
    least, most = score_bounds(low, high)
    if least:
        rows = rows.where(F.col("importance_score") >= least)
    if most:
        rows = rows.where(F.col("importance_score") <= most)
    if period in PERIODS:
        rows = rows.where(F.datediff(F.lit(as_of), "published_on").between(0, PERIODS[period]))
    holds = lambda c, x: F.coalesce(F.contains(c, F.lit(x)), F.lit(False))
    if text:
        rows = rows.where(holds("title", text) | holds("body", text))
    for name, part in advanced.items():
        if part:
            rows = rows.where(holds(ADVANCED[name], part))
    return rows


def order_by(sort: str = "recent") -> list[Column]:
    """recent: newest first; score: those registered by hand first, then by score."""
    recent = [F.desc("published_on"), F.desc("id")]
    return [(F.col("source_type") == "manual").desc(), F.desc("importance_score"), *recent] if sort == "score" else recent


def visible(rows: DataFrame, outlets: DataFrame) -> DataFrame:
    """Active articles of approved outlets."""
    return rows.where("status = 'active'").join(outlets.where("status = 'approved'").select("press").distinct(), "press", "left_semi")


def history(rows: DataFrame, category: str, as_of: date, p: Params = DEFAULT) -> DataFrame:
    """The newest articles of a category within the history's days, at most its rows."""
    age = F.datediff(F.lit(as_of), "published_on")
    return rows.where(age.between(0, p.history_days) & F.array_contains("categories", category)).orderBy(F.desc("published_on"), F.desc("id")).limit(p.history_rows)


def dashboard(articles: DataFrame, queue: DataFrame, log: DataFrame, as_of: date) -> DataFrame:
    """One row: total, today, last_collected, analysis_pending, notify_failed, log_total."""
    a = articles.agg(F.count("*").alias("total"), F.count_if(F.col("published_on") == F.lit(as_of)).alias("today"), F.max("published_on").alias("last_collected"), F.count_if(F.col("tone") == "unrated").alias("analysis_pending"))
    b = queue.agg(F.count_if(F.col("state") == "failed").alias("notify_failed"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(log.agg(F.count("*").alias("log_total"))))  # one row each


def drill_down(rows: DataFrame, column: str, value: str, n: int) -> DataFrame:
    """The newest rows behind a dashboard's number."""
    return rows.where(F.col(column) == value).orderBy(F.desc("day"), F.desc("id")).limit(n)


def keyword_status(keywords: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """position, category, enabled and total of each category, in the fixed order, others after it by name."""
    place = F.create_map(*[x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))])
    counts = keywords.groupBy("category").agg(F.count_if(F.col("enabled")).alias("enabled"), F.count("*").alias("total"))
    return counts.select(F.coalesce(F.try_element_at(place, F.col("category")), F.lit(len(categories))).cast("long").alias("position"), "category", "enabled", "total")


def reporters(rows: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """press, author, n and counts by tone of the window's articles, and each reporter's place in its outlet: most
    articles first, then by name. Reporters are a dimension of the size of the outlets, not of the articles."""
    rows = rows.where(F.datediff(F.lit(as_of), "published_on").between(0, days - 1) & (F.coalesce(F.trim("author"), F.lit("")) != ""))
    counts = rows.groupBy("press", "author").agg(F.count("*").alias("n"), *[F.count_if(F.col("tone") == t).alias(t) for t in ("positive", "negative")])
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("press").orderBy(F.desc("n"), "author")).cast("long"))


def with_names(rows: DataFrame, named: DataFrame, outlets: DataFrame) -> DataFrame:
    """rows (page_id, host) with their outlet: the longest of a host's names that is an outlet's domain. Hosts that no
    outlet has become pending outlets under their registered name; they never hold a row back."""
    found = named.join(outlets.select(F.col("domain").alias("name"), "outlet"), "name").groupBy("page_id").agg(F.max_by("outlet", F.struct(F.char_length("name"), F.col("name"))).alias("outlet"))
    return rows.join(found, "page_id", "left")


def pending_outlets(rows: DataFrame) -> DataFrame:
    """domain and n of the hosts without an outlet, to be approved."""
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    return rows.where(F.col("outlet").isNull() & (F.coalesce("host", F.lit("")) != "")).groupBy(F.coalesce(F.nullif(domain, F.lit("")), F.col("host")).alias("domain")).agg(F.count("*").alias("n"))


def weekly(articles: DataFrame, items: DataFrame, as_of: date, items_as_of: date, p: Params = DEFAULT, days: int = 7) -> DataFrame:
    """The week's report: articles by category and tone, and the newest items of each type, at most so many a type."""
    a = articles.where(F.datediff(F.lit(as_of), "published_on").between(1, days)).groupBy(F.col("category").alias("part"), F.col("tone").alias("of")).agg(F.count("*").alias("n"), F.round(F.avg("importance_score"), 4).alias("mean_score"))
    week = items.where(F.datediff(F.lit(items_as_of), "collected_on").between(1, days))
    newest = F.row_number().over(Window.partitionBy("item_type").orderBy(F.desc("collected_on"), "id"))
    b = week.withColumn("rn", newest).where(F.col("rn") <= p.report_items).groupBy("item_type").agg(F.count("*").alias("n"))
    return a.select(F.lit("articles").alias("kind"), "part", "of", "n", "mean_score").unionByName(b.select(F.lit("items").alias("kind"), F.col("item_type").alias("part"), F.lit("").alias("of"), "n", F.lit(None).cast("double").alias("mean_score")))


def in_turns(rows: DataFrame, groups: str, order: list[Column], cap: int, id_col: str = "id") -> DataFrame:
    """At most `cap` articles, companies in turn, so that none fills a run: an article counts for the first company it
    names. order ends with the id."""
    company = F.coalesce(F.get(F.col(groups), F.lit(0)), F.lit(""))
    turn = F.row_number().over(Window.partitionBy("company").orderBy(*order))
    return rows.withColumn("company", company).withColumn("turn", turn).where(F.col("turn") <= cap).orderBy("turn", "company", id_col).limit(cap)


def bodies(items: DataFrame, fetched: DataFrame, url: str = "url_source") -> DataFrame:
    """items with body, from what was fetched again by url; '' where it isn't there. Of several bodies of a url, the
    longest, then the least."""
    one = fetched.groupBy(F.col("url").alias("of")).agg(F.min_by("body", F.struct(-F.length("body"), F.col("body"))).alias("body"))
    return items.join(one, F.col(url) == F.col("of"), "left").drop("of").withColumn("body", F.coalesce("body", F.lit("")))


def matching(rows: DataFrame, keywords: tuple[str, ...], *columns: str) -> DataFrame:
    """Rows that hold a keyword, for feeds that can't be asked for one; matched: the first keyword found."""
    text = F.concat_ws("\n", *columns)
    found = F.get(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k)), F.lit(0))
    return rows.withColumn("matched", found).where("matched is not null")


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests)
