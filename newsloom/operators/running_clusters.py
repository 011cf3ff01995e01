"""Groups of duplicates that later runs extend.

The state is a table of labels, a row for each article: its group, and which of the group stands for it. A run brings new
articles and links among them and to older ones. Only the groups that its links touch are joined, named anew, and asked for
a representative again; what the run leaves alone is read and written as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .components import components

#: An article, its group (the least id that links reach), whether it stands for the group, and what that depends on.
FIELDS = ("id", "grp", "is_representative", "tier", "no_body", "published_on", "url")


def of_articles(rows: DataFrame, outlets: DataFrame) -> DataFrame:
    """Rows for extended(), from articles (id, press, body, published_on, url): the body itself isn't kept."""
    rows = rows.join(outlets.select("press", "tier"), "press", "left")
    return rows.select("id", F.coalesce("tier", F.lit(9)).alias("tier"), (F.coalesce(F.col("body"), F.lit("")) == "").alias("no_body"), "published_on", "url")


def extended(labels: DataFrame | None, new: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after a run, as a table: labels before it (None: there are none), its new articles as of_articles() gives
    them, and its links (a, b) between ids, in any order of runs. Ids of links that aren't articles yet are kept as rows
    without a tier: they hold groups together, stand for none, and become articles when these come. An article that labels
    hold isn't new; of rows that repeat an id one counts."""
    spark = new.sparkSession
    empty = spark.createDataFrame([], new.select("id", F.col("id").alias("grp"), F.lit(True).alias("is_representative"), "tier", "no_body", "published_on", "url").schema)
    held = empty if labels is None else labels.select(*FIELDS)
    known, waiting = held.where("tier is not null"), held.where("tier is null")
    fresh = new.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti").join(waiting.select("id", F.col("grp").alias("old")), "id", "left")
    fresh = written(fresh, "cluster-new")
    rows = known.unionByName(fresh.select("id", F.coalesce("old", "id").alias("grp"), F.col("old").isNull().alias("is_representative"), "tier", "no_body", "published_on", "url"))
    rows = rows.unionByName(waiting.join(fresh.select("id"), "id", "left_anti"))
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(rows.select("id"), "id", "left_anti")
    rows = written(rows.unionByName(ends.withColumn("grp", F.col("id")).withColumn("is_representative", F.lit(False)), allowMissingColumns=True), "cluster-rows")
    of = lambda end, name: rows.select(F.col("id").alias(end), F.col("grp").alias(name))
    joined = links.select("a", "b").join(of("a", "ga"), "a").join(of("b", "gb"), "b").where("ga <> gb")
    names = components(joined.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("grp"), F.col("component").alias("into"))
    came = fresh.where("old is not null").select(F.col("old").alias("grp")).distinct()
    names = written(names.unionByName(came.join(names.select("grp"), "grp", "left_anti").withColumn("into", F.col("grp"))), "cluster-names")
    touched = rows.join(names, "grp")
    best = F.min_by("id", F.struct(F.col("tier").isNull(), "tier", "no_body", "published_on", "id"))
    touched = touched.join(touched.groupBy("into").agg(best.alias("one")), "into")
    stands = (F.col("id") == F.col("one")) & F.col("tier").isNotNull()
    again = touched.select("id", F.col("into").alias("grp"), stands.alias("is_representative"), "tier", "no_body", "published_on", "url")
    return written(rows.join(names, "grp", "left_anti").select(*FIELDS).unionByName(again), "cluster-labels")


def with_aliases(labels: DataFrame) -> DataFrame:
    """id, grp, is_representative, and on representatives the aliases: the group's other urls."""
    labels = labels.where("tier is not null")
    others = labels.where(~F.col("is_representative")).groupBy(F.col("grp").alias("of")).agg(F.array_sort(F.collect_set("url")).alias("aliases"))
    done = labels.join(others, (F.col("grp") == F.col("of")) & F.col("is_representative"), "left")
    return done.select("id", "grp", "is_representative", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
