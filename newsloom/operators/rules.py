"""Rule engines: relevance, categories, scores and their explanation. Dictionaries are arguments; matching is a literal
array predicate, never a join, so it stays inside one scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def terms_without_agencies(keywords: DataFrame, agencies: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """Enabled keywords (of the categories, where some are named) that aren't an agency's name or short name: an agency
    alone never makes an item relevant."""
    names = agencies.select(F.explode(F.array("name", "short_name")).alias("keyword"))
    chosen = keywords.where("enabled")
    if categories:
        chosen = chosen.where(F.col("category").isin(*categories))
    return chosen.select("keyword").distinct().join(names, "keyword", "left_anti")


def relevant(title: Column, law: Column, terms: tuple[str, ...], extra: tuple[str, ...] = (), grant: Column | None = None, grant_terms: tuple[str, ...] = ()) -> Column:
    """Whether the title or the law holds a term. A grant's law column holds something else (a department), so its title
    alone counts, and it has further terms."""
    both = F.concat_ws("\n", title, law)
    if grant is None:
        return has_any(both, (*terms, *extra))
    grant = F.coalesce(grant, F.lit(False))
    return F.when(grant, has_any(title, (*terms, *extra, *grant_terms))).otherwise(has_any(both, (*terms, *extra)))


def trade_relevant(industry: Column, info: Column, title: Column, industries: tuple[str, ...], infos: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """Trade news counts by a part of its industry, by its information class as a whole, or by a word of its title."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    return has_any(blank(industry), industries) | F.trim(blank(info)).isin(*infos) | has_any(blank(title), words)


def rule_impact(title: Column, levels: dict[str, tuple[str, ...]], texts: dict[str, str], action: str) -> Column:
    """struct<summary, level, rationale, action> of an item that rules judge alone: the first level whose words the title
    holds, else none; the title is the summary. texts: each level's rationale, none's included."""
    level = first_category(F.coalesce(title, F.lit("")), levels, "none")
    said = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.struct(title.alias("summary"), level.alias("level"), F.element_at(said, level).alias("rationale"), F.when(level != "none", action).alias("action"))


def placeholder(item_type: Column, body: Column, types: tuple[str, ...], summary: str, rationale: str, least: int = 40) -> Column:
    """struct<summary, level, rationale> for items of these types whose body is too short to judge; null for others."""
    short = F.char_length(F.trim(F.coalesce(body, F.lit("")))) < least
    return F.when(item_type.isin(*types) & short, F.struct(F.lit(summary).alias("summary"), F.lit("none").alias("level"), F.lit(rationale).alias("rationale")))


def first_category(text: Column, rules: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The first rule that matches."""
    out = F.lit(other)
    for name, words in reversed(rules.items()):
        out = F.when(has_any(text, words), name).otherwise(out)
    return out


def all_categories(text: Column, rules: dict[str, tuple[str, ...]]) -> Column:
    """Every rule that matches, in order."""
    return F.filter(F.array(*[F.when(has_any(text, words), name) for name, words in rules.items()]), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Rule:
    label: str
    points: int
    words: tuple[str, ...]
    scope: str = "both"  # title, body or both
    enabled: bool = True


def contributions(title: Column, body: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct<label, points>> of the rules that apply."""
    where = {"title": title, "body": body, "both": F.concat_ws("\n", title, body)}
    parts = [F.when(has_any(where[r.scope], r.words), F.struct(F.lit(r.label).alias("label"), F.lit(r.points).cast("long").alias("points"))) for r in rules if r.enabled]
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<struct<label:string,points:bigint>>")


def clamped(parts: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + x["points"])))


#: Limits of custom rules.
MOST_RULES, MOST_POINTS = 30, 100


def within_limits(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """At most MOST_RULES rules that have words, with points within MOST_POINTS either way."""
    usable = [r for r in rules if any(r.words)][:MOST_RULES]
    return tuple(replace(r, points=max(-MOST_POINTS, min(MOST_POINTS, r.points))) for r in usable)


#: A citation: an article, paragraph or item by number, or a quotation of ten characters or more; fixed values.
CITATION = r"제\s?\d+\s?(?:조|항|호)|[\"“][^\"”]{10,}[\"”]"
#: For sources in English, beside it.
ENGLISH_CITATION = CITATION + r"|(?i:\b(?:article|section|paragraph)\s*\d+)"


def sane_impact(level: Column, rationale: Column, citation: str = CITATION) -> Column:
    """Unknown levels are none; high and medium without a citation are low."""
    level = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    level = F.when(level.isin("high", "medium", "low", "none"), level).otherwise("none")
    cited = F.coalesce(rationale.rlike(citation), F.lit(False))
    return F.when(level.isin("high", "medium") & ~cited, "low").otherwise(level)


def sane_analysis(level: Column, rationale: Column, implication: Column, related: Column, no_citation: str, no_rationale: str, citation: str = CITATION) -> Column:
    """struct<level, rationale, implication>: the sane level; a default where the rationale is missing, which differs for
    what was judged high or medium; an implication only where the item is related and its level isn't none."""
    said = F.trim(F.coalesce(rationale, F.lit("")))
    claimed = F.lower(F.trim(F.coalesce(level, F.lit("")))).isin("high", "medium")
    sane = sane_impact(level, rationale, citation)
    text = F.when(said != "", said).when(claimed, no_citation).otherwise(no_rationale)
    kept = F.when(F.coalesce(related, F.lit(False)) & (sane != "none"), F.trim(implication)).otherwise("")
    return F.struct(sane.alias("level"), text.alias("rationale"), F.coalesce(kept, F.lit("")).alias("implication"))


def sane_tone(tone: Column, tones: tuple[str, ...] = ("positive", "neutral", "negative")) -> Column:
    return F.when(tone.isin(*tones), tone).otherwise("neutral")


def normal_groups(groups: Column, subsidiaries: dict[str, tuple[str, ...]]) -> Column:
    """Known groups, each once and in order, without a parent beside one of its subsidiaries. subsidiaries: those of each
    parent; a group without any has an empty tuple."""
    known = [*subsidiaries, *(x for xs in subsidiaries.values() for x in xs)]
    found = F.array_distinct(F.filter(groups, lambda g: g.isin(*known)))
    for parent, mine in subsidiaries.items():
        if mine:
            found = F.when(F.arrays_overlap(found, F.array(*map(F.lit, mine))), F.array_remove(found, parent)).otherwise(found)
    return found


def normal_keywords(keywords: Column, groups: Column, most: int = 6) -> Column:
    """At most `most` keywords, each once, none blank and none a group."""
    return F.slice(F.array_except(F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != ""), groups), 1, most)


def swot_total(s: Column, w: Column, o: Column, t: Column, snippet: Column | None = None) -> Column:
    """(S + O) - (W + T), brought to 0..100. A missing part counts 0; null where all are missing, and for snippets."""
    part = lambda x: F.coalesce(x, F.lit(0))
    total = F.when(F.coalesce(s, w, o, t).isNotNull(), F.round((part(s) + part(o) - part(w) - part(t) + 200) / 4).cast("long"))
    return total if snippet is None else F.when(~F.coalesce(snippet, F.lit(False)), total)


def swot_top(parts: Column, least: int = 31, most: int = 3, nothing: str = "") -> Column:
    """The highest parts of array<struct<name, score, text>> that reach `least` and say something; equal ones keep their
    order."""
    placed = F.transform(parts, lambda p, i: F.struct((-p["score"]).alias("k"), i.alias("i"), p.alias("p")))
    said = F.filter(placed, lambda x: (x["p"]["score"] >= least) & (F.coalesce(x["p"]["text"], F.lit("")) != "") & (x["p"]["text"] != (nothing or "\x00")))
    return F.transform(F.slice(F.array_sort(said), 1, most), lambda x: x["p"])
