"""Policy items: the joined view, its filters, orders, pages, facets and calendar."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bills, jsonx
from ..functions import text as X
from ..functions.dates import d_day, month_of
from ..params import DEFAULT, Params


#: What breaks ties between analyses of one item.
LATEST = ("created_on", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def latest_analyses(analyses: DataFrame, *also: str) -> DataFrame:
    """One analysis an item: the last, every tie broken. also: further columns of it."""
    last = F.max_by(F.struct("impact_level", "created_on", *also), F.struct(*LATEST)).alias("x")
    return analyses.groupBy("policy_item_id").agg(last).select("policy_item_id", F.col("x.impact_level").alias("impact"), F.col("x.created_on").alias("analysed_on"), *[F.col(f"x.{c}") for c in also])


def agency_column(name: str = "agency_name", raw: str = "agency_raw") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(raw, F.lit("")))


def joined(items: DataFrame, agencies: DataFrame, analyses: DataFrame, *also: str) -> DataFrame:
    """Items with their agency's name (else the raw one) and latest impact ('' where not analysed). Filters on items
    alone belong before it. also: further columns of the latest analysis."""
    names = agencies.select(F.col("id").alias("agency_id"), F.col("name").alias("agency_name"))
    rows = items.join(names, "agency_id", "left").join(latest_analyses(analyses, *also), items.id == F.col("policy_item_id"), "left")
    return rows.withColumn("agency", agency_column()).withColumn("impact", F.coalesce("impact", F.lit("")))


def joined_few(items: DataFrame, agencies: DataFrame, analyses: DataFrame, *also: str) -> DataFrame:
    """The same for few items, as filters or a page leave them: only their analyses are aggregated."""
    mine = analyses.join(items.select(F.col("id").alias("policy_item_id")), "policy_item_id", "left_semi")
    return joined(items, agencies, mine, *also)


def chosen(rows: DataFrame, p: Params = DEFAULT, item_types=(), agencies=(), impacts=(), statuses=(), groups=(), priorities=(), due: int | None = None, text: str = "") -> DataFrame:
    """Facet filters: any value inside a facet, every facet together; an empty facet or a due that isn't offered filters
    nothing. text is searched in title, law_name and summary, of those that rows has."""
    for column, wanted in (("item_type", item_types), ("agency", agencies), ("impact", impacts), ("priority", priorities)):
        if wanted:
            rows = rows.where(F.col(column).isin(*wanted))
    if statuses:
        rows = rows.where(F.coalesce("status", F.lit("")).isin(*statuses))
    if groups:
        rows = rows.where(F.arrays_overlap("group_companies", F.array(*map(F.lit, groups))))
    if due in p.due_choices:
        rows = rows.where(due_within(F.col("notice_end"), p.as_of, due))
    if text:
        places = [F.coalesce(F.contains(c, F.lit(text)), F.lit(False)) for c in ("title", "law_name", "summary") if c in rows.columns]
        rows = rows.where(reduce(lambda a, b: a | b, places))
    return rows


def view(rows: DataFrame, p: Params = DEFAULT, interest: tuple[str, ...] = (), direct_words: tuple[str, ...] = (), focus: str = "", stages: str = "", placeholder: str = "", status_words: tuple[str, ...] = X.STATUS_WORDS) -> DataFrame:
    """The item as its readers see it, from joined() rows with the stored columns: decoded lists, cleaned agency, days
    left, priority and its reason (from the stored summary), and then the card's lines, which joined are the summary that is
    shown. '' stands for null texts."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    webzine = F.col("item_type") == "trade_webzine"
    # what several columns use is a column first, so that it is computed once
    rows = rows.withColumns({"_parts": bills.unpacked(F.col("suggested_action")), "_stored": jsonx.string_list(F.col("proposers")), "_files": jsonx.string_list(F.col("attachments")), "_named": X.clean_agency(F.col("agency_name"), status_words)})
    parts, stored, files = F.col("_parts"), F.col("_stored"), F.col("_files")
    rows = rows.select(
        "id", text("title"), F.coalesce(F.nullif("url_canonical", F.lit("")), "url_source", F.lit("")).alias("url"), text("item_type"), text("category"), text("law_name"),
        F.coalesce(F.nullif("_named", F.lit("")), X.clean_agency(F.col("agency_raw"), status_words)).alias("agency"),
        "notice_start", "notice_end", d_day(F.col("notice_end"), p.as_of).cast("long").alias("d_day"), text("status"), text("opinion_url"),
        F.when(webzine, F.array().cast("array<string>")).otherwise(files).alias("attachment_urls"), F.when(webzine, F.coalesce(F.get(files, F.lit(0)), F.lit(""))).alias("thumbnail"),
        F.col("impact").alias("impact_level"), text("summary"), text("impact_rationale"), jsonx.clean_list(jsonx.string_list(F.col("affected_areas"))).alias("affected_areas"),
        parts["action"].alias("suggested_action"), F.when(F.col("impact") == "none", "").otherwise(parts["implication"]).alias("implication"),
        jsonx.string_list(F.col("groups")).alias("group_companies"), F.coalesce(F.col("published_at").cast("string"), F.lit("")).alias("published_at"), "collected_on",
        F.when((F.size(stored) == 0) & (F.col("item_type") == "bill"), F.coalesce(F.array(bills.sponsor_in(F.col("title"))["name"]), F.array())).otherwise(stored).alias("proposers"),
        bills.sponsors_total(stored, F.col("title"), F.col("item_type") == "bill").alias("proposer_total"),
    )
    rows = rows.withColumn("proposers", F.filter("proposers", lambda n: n.isNotNull()))
    rows = rows.withColumn("_judged", tier(direct_words, focus, interest, stages, p))
    rows = rows.withColumns({"priority": F.col("_judged.priority"), "priority_reason": F.col("_judged.reason")}).drop("_judged")
    lines = bills.card_lines(F.col("summary"), F.col("title"), F.col("law_name"), F.col("notice_start"), F.col("notice_end"), F.col("published_at"), F.col("status"), F.col("impact_rationale"), placeholder)
    rows = rows.withColumn("summary_lines", lines)
    return rows.withColumn("summary", F.array_join("summary_lines", "\n"))


def tier(direct_words: tuple[str, ...], focus: str, interest: tuple[str, ...], stages: str, p: Params = DEFAULT) -> Column:
    """struct<priority, reason> of a view row. 3 where the item is direct: its impact isn't none, and the focus group is
    among its groups, or its title has a direct word and the impact isn't low, or the impact is high. 2 where another
    group, a medium or low impact or a category of interest holds, else 1. A direct item's reason tells whether it is
    imminent: a stage's pattern in its texts, or a deadline within the imminent days."""
    word = F.lit(None).cast("string")
    for w in reversed(direct_words):
        word = F.when(F.contains("title", F.lit(w)), w).otherwise(word)
    focused = F.array_contains("group_companies", focus)
    direct = (F.col("impact_level") != "none") & (focused | (word.isNotNull() & (F.col("impact_level") != "low")) | (F.col("impact_level") == "high"))
    why = F.when(focused, "focus group").when(word.isNotNull(), F.concat(F.lit("title: "), word)).otherwise("high impact")
    texts = F.concat_ws(" ", "title", "summary", "impact_rationale", "law_name", "status")
    stage = F.nullif(F.regexp_extract(texts, stages, 0), F.lit("")) if stages else F.lit(None).cast("string")
    when = F.when(F.col("d_day").between(0, p.imminent_days), F.concat(F.lit("D-"), F.col("d_day").cast("string"))).otherwise(stage)
    others = F.array_except("group_companies", F.array(F.lit(focus)))
    related = (F.size(others) > 0) | F.col("impact_level").isin("medium", "low") | F.col("category").isin(*(interest or ("",)))
    basis = F.when(F.size(others) > 0, F.concat(F.lit("groups: "), F.array_join(others, ", "))).when(F.col("impact_level").isin("medium", "low"), F.concat(F.lit("impact: "), F.col("impact_level"))).otherwise(F.concat(F.lit("category: "), F.col("category")))
    return F.when(direct, F.struct(F.lit(3).alias("priority"), F.concat_ws(" + ", why, when).alias("reason"))).when(related, F.struct(F.lit(2).alias("priority"), basis.alias("reason"))).otherwise(F.struct(F.lit(1).alias("priority"), F.lit("other").alias("reason")))


def without_groups(items: DataFrame) -> DataFrame:
    """Items whose groups are still to be found: null, empty or an empty list."""
    return items.where(F.coalesce(F.trim("groups"), F.lit("")).isin("", "[]"))


def due_within(end: Column, today: date, days: int) -> Column:
    return end.between(F.lit(today), F.date_add(F.lit(today), days))


def impact_rank(p: Params = DEFAULT) -> Column:
    out = F.lit(0)
    for level, rank in p.ranks.items():
        out = F.when(F.col("impact") == level, rank).otherwise(out)
    return out


def order_by(sort: str, p: Params = DEFAULT) -> list[Column]:
    """deadline (default), recent, impact, priority; each ends with the id, so that ranks are stable."""
    deadline = [F.col("notice_end").asc_nulls_last(), F.col("collected_on").desc(), F.col("id").asc()]
    recent = [F.coalesce("notice_start", "collected_on").desc(), F.col("collected_on").desc(), F.col("id").asc()]
    return {"recent": recent, "impact": [impact_rank(p).desc(), *deadline], "priority": [F.col("priority").desc(), *recent]}.get(sort, deadline)


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 9, most: int = 100) -> DataFrame:
    """One page of the ordered rows, with rank and the total before paging. The page is cut by a top-k, not by a sort of
    everything in one task."""
    size, number = min(max(size, 1), most), max(number, 1)
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy(*order).limit(number * size)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return top.where(F.col("rank") > (number - 1) * size).crossJoin(F.broadcast(total))  # one row


def after_key(rows: DataFrame, day: Column, last_day: date, last_id: int, size: int) -> DataFrame:
    """The next rows after a (day, id) cursor, newest first."""
    return rows.where((day < F.lit(last_day)) | ((day == F.lit(last_day)) & (F.col("id") < last_id))).orderBy(day.desc(), F.col("id").desc()).limit(size)


def priority(title_words: tuple[str, ...], groups: tuple[str, ...], p: Params = DEFAULT) -> Column:
    """3, 2 or 1. Direct: an impact that isn't none, and a focus group in the title, a title word with an impact above low,
    or a high impact. Direct items are top, others with a group or a low or medium impact are middle."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("title"), w))
    related = ~F.col("impact").isin("none", "")
    direct = related & (has(groups) | (has(title_words) & (F.col("impact") != "low")) | (F.col("impact") == "high"))
    return F.when(direct, 3).when(has(groups) | F.col("impact").isin("medium", "low"), 2).otherwise(1)


def priority_reason(p: Params = DEFAULT) -> Column:
    imminent = d_day(F.col("notice_end"), p.as_of).between(0, p.imminent_days)
    return F.when((F.col("priority") == 3) & F.coalesce(imminent, F.lit(False)), "direct, imminent").when(F.col("priority") == 3, "direct").when(F.col("priority") == 2, "related").otherwise("other")


def placeholders(items: DataFrame, analyses: DataFrame, prefix: str, n: int) -> DataFrame:
    """Items whose analysis only says that there was nothing to judge, newest first."""
    rows = items.join(latest_analyses(analyses, "summary"), items.id == F.col("policy_item_id")).where(F.col("summary").startswith(prefix))
    return rows.orderBy(F.desc("collected_on"), "id").limit(n)


def without_implication(items: DataFrame, analyses: DataFrame, n: int, w: bills.Words = bills.DEFAULT, rule_model: str = "rule") -> DataFrame:
    """Items whose analysis carries no implication mark and isn't a rule's: high and medium impacts first, then newest."""
    rows = items.join(latest_analyses(analyses, "suggested_action", "model"), items.id == F.col("policy_item_id"))
    rows = rows.where(~F.contains(F.coalesce("suggested_action", F.lit("")), F.lit(w.implication)) & (F.coalesce("model", F.lit("")) != rule_model))
    return rows.orderBy(F.col("impact").isin("high", "medium").desc(), F.desc("collected_on"), "id").limit(n)


def to_reanalyse(items: DataFrame, analyses: DataFrame, prefix: str, n: int, w: bills.Words = bills.DEFAULT) -> DataFrame:
    """id and why of items to judge again, each once, at most n: bills whose summary echoes their title, placeholders, and
    those without an implication, in this order."""
    rows = items.join(latest_analyses(analyses, "suggested_action", "model", "summary"), items.id == F.col("policy_item_id"))
    open_ = ~F.contains(F.coalesce("suggested_action", F.lit("")), F.lit(w.implication)) & (F.coalesce("model", F.lit("")) != "rule")
    echo = (F.col("item_type") == "bill") & F.coalesce(bills.echoes(F.col("title"), F.col("summary")), F.lit(False))
    why = F.when(echo, 1).when(F.coalesce(F.col("summary").startswith(prefix), F.lit(False)), 2).when(open_, 3)
    return rows.withColumn("why", why).where("why is not null").orderBy("why", F.desc("collected_on"), "id").limit(n).select("id", F.col("why").cast("long").alias("why"))


def unanalysed(items: DataFrame, analyses: DataFrame) -> DataFrame:
    return items.join(analyses, items.id == analyses.policy_item_id, "left_anti")


def relinked(items: DataFrame, agencies: DataFrame) -> DataFrame:
    """agency_id filled from the raw name where it's null and names an agency."""
    names = agencies.groupBy(F.col("name").alias("agency_raw")).agg(F.min("id").alias("found"))
    return items.join(names, "agency_raw", "left").withColumn("agency_id", F.coalesce("agency_id", "found")).drop("found")


def named(queries: DataFrame, agencies: DataFrame) -> DataFrame:
    """The first agency that has q as its name or short name; as an equi join on both names, not an OR."""
    names = agencies.select("id", F.explode(F.array("name", "short_name")).alias("q")).groupBy("q").agg(F.min("id").alias("agency_id"))
    return queries.join(names, "q", "left")


def agency_facet(rows: DataFrame, agencies: DataFrame, kind: str) -> DataFrame:
    """Counts by agency, with seeded names of the kind that have none. facet_order() tells the order of such counts."""
    seen = rows.where(F.col("agency").isNotNull()).groupBy("agency").agg(F.count("*").alias("n"))
    seeds = agencies.where((F.col("kind") == kind) & F.col("enabled")).select(F.col("name").alias("agency"), F.lit(0).cast("long").alias("n"))
    return seen.union(seeds).groupBy("agency").agg(F.sum("n").alias("n"))


def group_facet(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Counts of items by every group that matches the title, in the groups' order, zeros included."""
    order = rows.sparkSession.createDataFrame([(i, g) for i, g in enumerate(groups)], "position bigint, grp string")
    found = rows.select(F.explode(matching_groups(F.col("title"), groups)).alias("grp")).groupBy("grp").agg(F.count("*").alias("n"))
    return order.join(found, "grp", "left").select("position", "grp", F.coalesce("n", F.lit(0)).alias("n"))


def matching_groups(text: Column, groups: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, groups)), lambda g: F.contains(text, g))


def category_of(types: dict[str, tuple[str, ...]]) -> Column:
    """The category key of an item's type: the first whose types hold it; null where none does."""
    out = F.lit(None).cast("string")
    for key, names in reversed(types.items()):
        if names:
            out = F.when(F.col("item_type").isin(*names), key).otherwise(out)
    return out


def statuses(rows: DataFrame) -> DataFrame:
    """The statuses there are, sorted: a few words."""
    return rows.where(F.coalesce("status", F.lit("")) != "").select("status").distinct().orderBy("status")


def facet_order(n: str = "n", name: str = "agency") -> list[Column]:
    return [F.col(n).desc(), F.col(name).asc()]


def analysed_since(analyses: DataFrame, midnight) -> DataFrame:
    return analyses.where(F.col("created_on") >= F.lit(midnight)).agg(F.count("*").alias("n"))


def totals(items: DataFrame, analyses: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """total, open, analysed, last_collected, in one pass over the items."""
    done = analyses.select(F.col("policy_item_id").alias("id")).distinct().withColumn("done", F.lit(1))
    rows = items.join(done, "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("notice_end") >= F.lit(p.as_of)).alias("open"), F.count("done").alias("analysed"), F.max("collected_on").alias("last_collected"))


def excluded(ledger: DataFrame) -> DataFrame:
    """How many urls the ledger keeps out."""
    return ledger.select("url").distinct().agg(F.count("*").alias("excluded"))


def calendar(rows: DataFrame, month: str, p: Params = DEFAULT) -> DataFrame:
    """Items that end in a month (YYYY-MM; today's month where the text is none). calendar_order() is their order."""
    start = month_of(F.lit(month), p.as_of)
    return rows.where((F.col("notice_end") >= start) & (F.col("notice_end") < F.add_months(start, 1)))


def calendar_order() -> list[Column]:
    return [F.col("notice_end").asc(), F.col("priority").desc(), F.coalesce("notice_start", "collected_on").desc(), F.col("collected_on").desc(), F.col("id").asc()]


def urgent(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Due within the urgent days and not closed, whichever word says closed."""
    return rows.where(due_within(F.col("notice_end"), p.as_of, p.urgent_days) & ~F.coalesce("status", F.lit("")).isin(*p.closed))


def urgent_head(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The first few urgent items by deadline, each with the number of all."""
    found = urgent(rows, p)
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("notice_end", "id").limit(p.urgent_shown).crossJoin(F.broadcast(total))  # one row


def interleaved(rows: DataFrame, kind: str, seq: str, cap: int) -> DataFrame:
    """Round robin by kind, kinds in order of first appearance, the first `cap`. No kind can give more than `cap` rows,
    so the window keeps no more of each (a limit inside the window, before its shuffle)."""
    opened = rows.groupBy(kind).agg(F.min(seq).alias("opened"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy(kind).orderBy(seq))).where(F.col("turn") <= cap)
    return rows.join(opened, kind).orderBy("turn", "opened").limit(cap)
