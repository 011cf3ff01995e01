"""Line dedup, on DataFrame and SQL functions alone.

Each line's key is hashed; the hashes are dealt by range and sorted by document and position, and windows over that
order tell first occurrences (of a key in a document) and how many documents hold the key. Only the positions to drop
leave that stage, as one compressed bitmap per document; texts meet their bitmap once, at the end.

One key may hold a third of all lines, and would land in one task. A frequency sketch names the heavy hashes first (at
most `heavy` of them, whatever the input's size); their lines are counted by partial aggregation instead, and their few
totals go back by a broadcast of at most `heavy` rows. What stays for the windows has keys of at most a few thousandths of
a percent of the lines each. The sketch decides only which way a line is counted, never the count.

A row is known by its id and a hash of id and text, so that two rows are taken for one only where both agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ASCII_SPACE, LOWER, UPPER

SHORTEST, DOCUMENTS = 20, 3
#: Hashes that are counted apart: at most HEAVY, of those that hold one in 5 * HEAVY of the lines that the sketch has seen.
HEAVY = 1000


def lines_of(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def folded(text: str):
    """The text with A-Z lower-cased; lower() does that where every character is ASCII, and much faster."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def hashed_lines(rows: DataFrame, shortest: int) -> DataFrame:
    """rid, doc, pos, h1, h2 of each line whose key has at least `shortest` code points; h1 and h2 are 128 bits of the key."""
    keys = F.transform(F.split(folded("text"), "\n", -1), lambda s, i: F.struct(i.alias("pos"), F.btrim(s, F.lit(ASCII_SPACE)).alias("key")))
    keys = F.filter(keys, lambda s: F.char_length(s["key"]) >= shortest)
    keys = F.transform(keys, lambda s: F.struct(s["pos"].alias("pos"), F.xxhash64(s["key"]).alias("h1"), F.xxhash64(F.lit(7), s["key"]).alias("h2")))
    return rows.select("rid", "doc", F.inline(keys))


def drop_bitmaps(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc, dropped: of each distinct row that loses lines, the bitmap of their positions as an array of 63-bit
    words, of which only those with a bit set are kept, each as struct<word, bits>. rid: hash of the id and the text; doc:
    the id."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).withColumn("rid", F.xxhash64("doc", "text"))
    lines = hashed_lines(rows, shortest)
    sketch = lines.agg(F.expr(f"approx_top_k(h1, {heavy}, {20 * heavy})").alias("top")).first()[0] or []
    seen = sum(t["count"] for t in sketch)
    hot = [t["item"] for t in sketch if t["count"] > 5000 and t["count"] * heavy * 5 > seen]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)

    by_key = Window.partitionBy("h1", "h2").orderBy("doc", "rid", "pos")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = lines.where(~is_hot) if hot else lines
    cold = cold.repartitionByRange(n, "h1", "h2")
    cold = cold.withColumn("first", (F.row_number().over(by_key) == 1) | ~F.col("doc").eqNullSafe(F.lag("doc").over(by_key)))
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cold = cold.withColumn("n", F.count_if(F.col("first") & F.col("doc").isNotNull()).over(whole) + F.max((F.col("first") & F.col("doc").isNull()).cast("int")).over(whole)).withColumn("keeper", F.max("doc").over(whole))
    dropped = cold.where((F.col("n") >= documents) & ~F.col("doc").eqNullSafe(F.col("keeper"))).select("rid", "doc", "pos")
    if hot:
        of_hot = lines.where(is_hot)
        totals = of_hot.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= documents)
        most = totals.select("h1", "h2", "keeper")
        hot_dropped = of_hot.join(F.broadcast(most), ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("rid", "doc", "pos")
        dropped = dropped.union(hot_dropped)
    words = dropped.groupBy("rid", "doc", F.floor(F.col("pos") / 63).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(63)).cast("int"))).alias("bits"))
    return words.groupBy("rid", "doc").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def dedup(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that other documents hold too.

    Adds n_lines long (before dropping), n_dropped long, dropped (the bitmap, null where nothing goes) and kept string
    (the text that stays). Keys of at least `shortest` code points found in at least `documents` documents lose all
    their lines except in the largest id that holds them. Documents are told apart by id: rows that repeat an id are one
    document; a null id is one document, smaller than all others. A null or empty text is one empty line. A column of
    docs that has one of the added names is replaced; other columns stay.
    """
    rows = docs.drop("dropped", "n_lines", "n_dropped", "kept")
    marks = drop_bitmaps(docs, shortest, documents, heavy, id_col, text_col).withColumnsRenamed({"rid": "rid_of_marks", "doc": "doc_of_marks"})
    same = (F.xxhash64(F.col(id_col), F.col(text_col)) == F.col("rid_of_marks")) & F.col(id_col).eqNullSafe(F.col("doc_of_marks"))
    rows = rows.join(marks, same, "left").drop("rid_of_marks", "doc_of_marks")
    lines, bits = lines_of(text_col), F.map_from_entries("dropped")
    gone = lambda i: F.coalesce(F.getbit(F.try_element_at(bits, F.floor(i / 63).cast("int")), F.pmod(i, F.lit(63)).cast("int")), F.lit(0)) == 1
    kept = F.when(F.col("dropped").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.filter(lines, lambda _, i: ~gone(i)), "\n"))
    n_dropped = F.coalesce(F.aggregate("dropped", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])), F.lit(0))
    n_lines = F.char_length(F.coalesce(F.col(text_col), F.lit(""))) - F.char_length(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(""))) + 1
    return rows.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long"), "kept": kept})


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return done.select(id_col, "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
