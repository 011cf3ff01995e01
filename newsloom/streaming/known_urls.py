"""The urls that were ever seen, as a table that a batch reads in small part.

A url's row lies in the folder of its bucket, which is a hash of the url, and there in the folder of the batch that wrote
it; files are sorted by url and carry Bloom filters, so that within a bucket Parquet passes over most of what a batch
doesn't ask for. A batch lists and reads the buckets of its own urls and no others, and the urls of the batch are the small
side of the join: history is neither listed, read nor shuffled as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A url, why it is known (stored, alias or the ledger's reason), the url that it is an alias of, and when it was seen first.
SCHEMA = "url string, why string, article string, seen bigint, batch bigint, bucket int"


@dataclass(frozen=True)
class KnownUrls:
    """The table under `path`. `buckets` belongs to the table: it is the same for all that write and read it; about as many
    as a batch has urls, so that a batch reads a small share of them."""

    path: str
    buckets: int = 1024

    def bucket(self, url: str | Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def remember(self, rows: DataFrame, batch: int) -> None:
        """Adds rows (url, why, article, seen), one for each url and why, as a batch's; a batch that runs again replaces what
        it wrote. Null and empty urls aren't urls."""
        rows = rows.where(F.coalesce("url", F.lit("")) != "").groupBy("url", "why").agg(F.min("article").alias("article"), F.min("seen").alias("seen"))
        rows = rows.withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": self.bucket("url")})
        put = rows.repartition("bucket").sortWithinPartitions("bucket", "url").write.partitionBy("bucket", "batch").mode("overwrite")
        put.option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#url", "true").parquet(self.path)

    def read(self, spark: SparkSession, buckets: list[int] | None = None) -> DataFrame:
        """The rows of some buckets (default: all); buckets that nothing was written to are empty, as an absent table is."""
        chosen = "bucket=*" if buckets is None else "bucket={" + ",".join(map(str, sorted(buckets))) + "}"
        try:
            return spark.read.schema(SCHEMA).option("basePath", self.path).parquet(f"{self.path}/{chosen}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], SCHEMA)

    def among(self, urls: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the table for a batch's urls (url), out of the buckets that these fall into. before: what this batch
        and later ones wrote doesn't count, so that a batch that runs again sees what it saw."""
        urls = urls.where(F.coalesce("url", F.lit("")) != "").select("url").distinct().withColumn("bucket", self.bucket("url"))
        wanted = [r.bucket for r in urls.select("bucket").distinct().collect()]  # at most `buckets` numbers
        found = self.read(urls.sparkSession, wanted)
        if before is not None:
            found = found.where(F.col("batch") < before)
        return found.join(urls, ["bucket", "url"], "left_semi")

    def compacted(self, spark: SparkSession, path: str, buckets: int | None = None) -> KnownUrls:
        """The same urls under another path, each once for each why, as one batch; for a table of many small batches, or one
        that needs more buckets. The streams that use it go on from there."""
        new = KnownUrls(path, buckets or self.buckets)
        new.remember(self.read(spark).drop("batch", "bucket"), -1)
        return new


def of_articles(store: DataFrame, url: str = "url", aliases: str = "aliases", seq: str = "") -> DataFrame:
    """Rows for KnownUrls.remember() from a store of articles: each url, and each of its aliases."""
    seen = F.col(seq).cast("long") if seq else F.lit(0).cast("long")
    of = [F.struct(F.col(url).alias("url"), F.lit("stored").alias("why"))]
    every = F.array(*of)
    if aliases in store.columns:
        every = F.concat(every, F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.struct(a.alias("url"), F.lit("alias").alias("why"))))
    return store.select(F.explode(every).alias("k"), F.col(url).alias("article"), seen.alias("seen")).select("k.*", "article", "seen")
