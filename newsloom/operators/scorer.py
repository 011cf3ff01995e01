"""Judging items: a scorer turns a title and a body into columns, and is called once for each group of duplicates.

A scorer is any function of two Columns that returns a struct column; a pandas function that asks a model fits as well
as expressions do. rule_scorer() is the deterministic one that needs no model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bills import excerpt
from ..functions.text import three_lines
from . import rules

Scorer = Callable[[Column, Column], Column]


def rule_scorer(score_rules: tuple[rules.Rule, ...], tones: dict[str, tuple[str, ...]], groups: dict[str, tuple[str, ...]], focus: tuple[str, ...] = ()) -> Scorer:
    """struct<score, tone, groups, summary, mention> by rules alone."""

    def score(title: Column, body: Column) -> Column:
        both = F.concat_ws("\n", title, body)
        return F.struct(
            rules.clamped(rules.contributions(title, body, rules.within_limits(score_rules))).alias("score"),
            rules.first_category(both, tones, "neutral").alias("tone"),
            rules.all_categories(both, groups).alias("groups"),
            F.array_join(three_lines(F.coalesce(body, F.lit(""))), "\n").alias("summary"),
            (excerpt(body, focus) if focus else F.lit(None).cast("string")).alias("mention"),
        )

    return score


def judged(rows: DataFrame, scorer: Scorer, group: str = "grp", representative: str = "is_representative", title: str = "title", body: str = "body") -> DataFrame:
    """rows with `judgement`, made of each group's representative and shared by its members. The scorer sees
    representatives alone, and where their bodies are, before the join; whoever drops bodies from rows shuffles none."""
    of_group = rows.where(F.col(representative)).select(F.col(group).alias("of"), scorer(F.col(title), F.col(body)).alias("judgement"))
    return rows.join(of_group, F.col(group) == F.col("of"), "left").drop("of")


#: A model: gets rows (dicts with id, title and text) and gives a summary for each, in order, or raises.
Ask = Callable[[list[dict]], list[str]]


def budgeted(rows: DataFrame, ask: Ask, budget: int, order: list[Column], batch: int = 16, tries: int = 3, pause: float = 0.0, workers: int = 4, id_col: str = "id", title: str = "title", body: str = "body", description: str = "description") -> DataFrame:
    """id, path and summary of each row, of which a run asks the model for the first `budget` by the order; rows are
    representatives, one a group. The order must end with a unique column, so that a run's choice is always the same.

    path tells what became of a row: `model` (asked with its body), `snippet` (asked with title and description, as there
    is no body), `fallback` (no try worked: title and description by rule) or `waiting` (beyond the budget: no summary, a
    later run's). Rows are asked in batches; of a batch that fails each is asked again alone, so that one row stops no
    other, until it has had so many tries, with a pause between that doubles. The budget counts rows: a failing row costs
    `tries` calls at most. Null titles and descriptions are empty."""
    text = lambda c: F.coalesce(c, F.lit("")) if c in rows.columns else F.lit("")
    known = rows.select(F.col(id_col).alias("id"), text(title).alias("title"), text(body).alias("body"), text(description).alias("description"))
    now = rows.orderBy(*order).limit(budget).select(F.col(id_col).alias("id"))
    chosen = known.join(now, "id", "left_semi")
    snippet = F.trim(F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("description", F.lit(""))))
    chosen = chosen.select("id", "title", F.when(F.trim("body") != "", F.col("body")).otherwise(snippet).alias("text"), (F.trim("body") != "").alias("whole"), snippet.alias("snippet")).repartition(workers)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for start in range(0, some.num_rows, batch):
                part = some.slice(start, batch).to_pylist()
                shown = [{"id": r["id"], "title": r["title"], "text": r["text"]} for r in part]
                found: list[str | None] = [None] * len(part)
                for attempt in range(tries):
                    left = [k for k, x in enumerate(found) if x is None]
                    if attempt and left:
                        time.sleep(pause * 2 ** (attempt - 1))
                    for group in [left] if attempt == 0 else [[k] for k in left]:
                        try:
                            made = ask([shown[k] for k in group])
                            if len(made) != len(group) or not all(isinstance(x, str) and x.strip() for x in made):
                                raise ValueError("not a summary for each row")
                        except Exception:  # noqa: BLE001 whatever stops a model, the row goes on without it
                            continue
                        for k, x in zip(group, made):
                            found[k] = x.strip()
                path = ["fallback" if x is None else "model" if r["whole"] else "snippet" for x, r in zip(found, part)]
                summary = [r["snippet"] if x is None else x for x, r in zip(found, part)]
                yield pa.RecordBatch.from_arrays([some.slice(start, batch).column("id"), pa.array(path), pa.array(summary, pa.string())], ["id", "path", "summary"])

    done = chosen.mapInArrow(asked, f"id {known.schema['id'].dataType.simpleString()}, path string, summary string")
    waiting = known.select("id").join(now, "id", "left_anti").select("id", F.lit("waiting").alias("path"), F.lit(None).cast("string").alias("summary"))
    return done.unionByName(waiting)
