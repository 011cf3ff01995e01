"""Notification decisions and the state of runs, as columns. Sending and fetching stay outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import in_night
from ..params import DEFAULT, Params
from ..storage import written
from .rules import has_any


def topic_match(title: Column, interest: tuple[str, ...], required: tuple[str, ...], excluded: tuple[str, ...] = ()) -> Column:
    """A topic's words: one of interest and one that is required, with both lists filled, and none excluded."""
    if not (interest and required):
        return F.lit(False)
    return has_any(title, interest) & has_any(title, required) & ~has_any(title, excluded)


def admission(excluded: Column, suppressed: Column, backfill: Column, topic_on: Column, score: Column, urgent: Column, p: Params = DEFAULT, topic: Column | None = None, published: Column | None = None, first_run: Column | None = None) -> Column:
    """The first reason that holds: an excluded word is absolute; a score at the threshold, a priority word or a topic's
    match queues, but nothing that was published before the first run."""
    wanted = (score >= p.threshold) | urgent
    if topic is not None:
        wanted = wanted | topic
    decision = F.when(excluded, "excluded").when(suppressed, "suppressed").when(backfill, "backfill").when(~topic_on, "topic_off").when(~F.coalesce(wanted, F.lit(False)), "below")
    if published is not None:
        decision = decision.when(published < first_run, "before_first_run")
    return decision.otherwise("queued")


def sendable(hour: Column, score: Column, urgent: Column, bypass: bool = False, p: Params = DEFAULT) -> Column:
    """send or wait: by night only scores at the night's least, or priority words with the bypass; a least that blocks
    the night leaves these alone."""
    by_night = ((score >= p.night_least) & F.lit(p.night_least < p.night_blocked)) | (urgent & F.lit(bypass))
    return F.when(in_night(hour, *p.night), F.when(by_night, "send").otherwise("wait")).otherwise(F.when((score >= p.threshold) | urgent, "send").otherwise("wait"))


def send_gate(paused: Column, excluded: Column, flood_until: Column, now: Column, hour: Column, score: Column, urgent: Column, bypass: bool = False, p: Params = DEFAULT) -> Column:
    """hold while sending is paused, drop what is excluded by now, skip while the channel asks to wait, else sendable()."""
    return F.when(paused, "hold").when(excluded, "drop").when(F.coalesce(flood_until > now, F.lit(False)), "skip").otherwise(sendable(hour, score, urgent, bypass, p))


def slots(rows: DataFrame, channel: str, order: list[Column], p: Params = DEFAULT) -> DataFrame:
    """Each channel's rows by rank: the round and the minute of sending.

    The rows are sorted by range and written, so that no channel is one task: a row's rank is its place in its partition
    and channel plus what the partitions before hold of the channel, of which there is one small row each."""
    sort = [F.col(channel), *order]
    placed = written(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", F.monotonically_increasing_id()), "slots")
    part = F.shiftright("at", 33).alias("part")
    counts = placed.groupBy(channel, part).agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = F.sum("n").over(Window.partitionBy(channel).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(channel, "part", "from", F.coalesce(before, F.lit(0)).alias("before"))
    done = placed.withColumn("part", part).join(counts, [channel, "part"])  # small, so that a broadcast is chosen where it is
    done = done.withColumn("turn", F.col("at") - F.col("from") + 1 + F.col("before")).drop("at", "part", "from", "before")
    return done.withColumns({"round": F.ceil(F.col("turn") / p.per_round), "minute": F.ceil(F.col("turn") / p.per_minute)})


def once(rows: DataFrame, sent: DataFrame, *key: str) -> DataFrame:
    """A row for each key that wasn't sent: the earliest."""
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct("ts", "event_id")).alias("first")).select("first.*")
    return first.join(sent.select(*key), list(key), "left_anti")


def suppressed_runs(runs: DataFrame, ts: str, p: Params = DEFAULT) -> DataFrame:
    """Runs that follow an outage, and the first: `quiet`. Gaps within a day come from a window over that day; a day's
    first run looks back to the last run of the day before it that has any, over one row a day."""
    day = F.to_date(ts)
    ends = runs.groupBy(day.alias("of_day")).agg(F.max(ts).alias("last"))
    ends = ends.select("of_day", F.lag("last").over(Window.orderBy("of_day")).alias("before"))
    rows = runs.withColumn("of_day", day).join(ends, "of_day", "left")
    previous = F.coalesce(F.lag(ts).over(Window.partitionBy("of_day").orderBy(ts)), "before")
    gap = F.col(ts).cast("long") - previous.cast("long")
    return rows.withColumn("quiet", F.coalesce(gap >= 60 * p.outage_minutes, F.lit(True))).drop("of_day", "before")


def recovering(runs: DataFrame, ts: str, p: Params = DEFAULT) -> DataFrame:
    """runs (ts, quiet, candidates, fresh, backlog) with suppressed: a quiet run opens a recovery, which lasts until a run
    is calm, that is until candidates, new ones and backlog are all below their limits; the calm run is the last one.
    Runs are a small table (one row a run)."""
    order = Window.orderBy(ts)
    calm = (F.col("candidates") < p.calm[0]) & (F.col("fresh") < p.calm[1]) & (F.col("backlog") < p.calm[2])
    rows = runs.withColumn("calm", calm).withColumn("opening", F.sum(F.col("quiet").cast("int")).over(order))
    within = Window.partitionBy("opening").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("calm").cast("int")).over(within), F.lit(0))
    return rows.withColumn("suppressed", (F.col("opening") > 0) & (ended == 0)).drop("calm", "opening")


def retried(attempts: DataFrame, *key: str, p: Params = DEFAULT) -> DataFrame:
    """key, tries, state of each message from its attempts (at, ok): sent once one worked, failed after the first try
    and its retries, else queued."""
    tries = attempts.groupBy(*key).agg(F.count("*").alias("tries"), F.max(F.col("ok").cast("int")).alias("worked"))
    return tries.select(*key, "tries", F.when(F.col("worked") == 1, "sent").when(F.col("tries") > p.retries, "failed").otherwise("queued").alias("state"))


def due_slot(now: Column, last: Column, p: Params = DEFAULT) -> Column:
    """struct<slot, run>: the last slot of the local day that has passed, and whether to run: no run since it, and none
    within the least gap. Both times are local."""
    hours = [h for h in sorted(p.slot_hours)]
    start = F.date_trunc("day", now)
    slot = F.array_max(F.filter(F.array(*[start + F.make_dt_interval(hours=F.lit(h)) for h in hours]), lambda s: s <= now))
    gap = last.isNull() | (last + F.make_dt_interval(hours=F.lit(p.slot_gap_hours)) <= now)
    return F.struct(slot.alias("slot"), F.coalesce(slot.isNotNull() & gap & (last.isNull() | (last < slot)), F.lit(False)).alias("run"))


def budget(own_used: Column, all_used: Column, p: Params = DEFAULT) -> Column:
    """Calls that are left today: the lesser of the own and the common limit's rest, never below 0."""
    return F.greatest(F.lit(0), F.least(F.lit(p.own_calls) - own_used, F.lit(p.daily_calls) - all_used))


def backlog(items: DataFrame, by_rule: tuple[str, ...], left: int) -> DataFrame:
    """What to judge now of the unanalysed: all that rules judge, and of the others as many as are left, the most urgent
    first."""
    rule = F.col("item_type").isin(*by_rule)
    others = items.where(~rule).orderBy(F.col("notice_end").asc_nulls_last(), "id").limit(left)
    return items.where(rule).withColumn("by", F.lit("rule")).unionByName(others.withColumn("by", F.lit("model")))


def quotes(ticks: DataFrame, symbol: str, ts: str, now, p: Params = DEFAULT) -> DataFrame:
    """symbol, price (of the first source that has one, at its last success), at and stale of each symbol."""
    price = F.coalesce("price", "fallback")
    good = ticks.where(price.isNotNull()).groupBy(symbol).agg(F.max_by(price, F.struct(ts, "event_id")).alias("price"), F.max(ts).alias("at"))
    return good.withColumn("stale", F.col("at") + F.make_dt_interval(mins=F.lit(p.quote_minutes)) < F.lit(now).cast("timestamp_ntz"))


def chat_answers(questions: DataFrame, chat: str, ts: str, p: Params = DEFAULT, id_col: str = "event_id") -> DataFrame:
    """Questions with allowed: the first so many of a chat in a clock hour get an answer."""
    by = Window.partitionBy(chat, F.date_trunc("hour", ts)).orderBy(ts, id_col)
    return questions.withColumn("allowed", F.row_number().over(by) <= p.chat_questions)


def command(articles: DataFrame, name: str, as_of, threshold: float = 0, text: str = "", n: int = 5) -> DataFrame:
    """What a chat command lists: latest, today, threshold or filter."""
    if name == "today":
        articles = articles.where(F.col("published_on") == F.lit(as_of))
    elif name == "threshold":
        articles = articles.where(F.col("importance_score") >= threshold)
    elif name == "filter":
        articles = articles.where(F.contains("title", F.lit(text)))
    return articles.orderBy(F.desc("published_on"), F.desc("id")).limit(n)


def drafts(actions: DataFrame, store: DataFrame, now, p: Params = DEFAULT) -> DataFrame:
    """url and state of urls registered by hand, from their actions (at, action: submit, confirm or discard): existing
    where the store has it, else what the last action says, where a draft that is too old is gone."""
    last = actions.groupBy("url").agg(F.max_by("action", F.struct("at", "event_id")).alias("action"), F.max("at").alias("at"))
    old = F.col("at") + F.make_dt_interval(hours=F.lit(p.draft_hours)) < F.lit(now).cast("timestamp_ntz")
    state = F.when(F.col("known"), "existing").when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "discard", "discarded").when(old, "expired").otherwise("draft")
    known = store.select("url", F.lit(True).alias("known")).distinct()
    return last.join(known, "url", "left").withColumn("known", F.coalesce("known", F.lit(False))).select("url", state.alias("state"))


def rotated(keywords: DataFrame, run: int, slots: int = 2, always: str = "") -> DataFrame:
    """The keywords to ask for in a run: all of the always category, and one in `slots` of the others, so that each comes
    once in so many runs. Keywords are a small dimension."""
    kept = keywords.where((F.col("category") == always)).select("keyword")
    others = keywords.where(F.col("category") != always).select("keyword").distinct().join(kept, "keyword", "left_anti")
    place = F.row_number().over(Window.orderBy("keyword")) - 1
    return kept.distinct().unionByName(others.withColumn("place", place).where(F.pmod("place", F.lit(slots)) == run % slots).select("keyword"))
