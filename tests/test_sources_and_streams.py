"""Source parsers on literal documents, and streams against the same programs over batches."""

from __future__ import annotations

from datetime import date

import compare
from pyspark.sql import functions as F

from newsloom.functions import bills
from newsloom.operators import gate, sinks
from newsloom.plans import catalogue
from newsloom.sources import feeds
from newsloom.streaming import gate_stream, windows


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles_and_names(spark):
    title = lambda t: value(spark, bills.sponsor_in(F.lit(t).cast("string")))
    assert tuple(title("나무법 고침 (홍길동의원 등 7인)")) == ("홍길동", 7)
    assert tuple(title("나무법 고침(이몽룡의원 대표발의)")) == ("이몽룡", 1)
    assert tuple(title("나무법 고침(이몽룡 위원장 대표 발의)")) == ("이몽룡", 1)
    assert tuple(title("나무법 [성춘향 외 0인] 안")) == ("성춘향", 1)
    assert title("나무법 (전부개정)") is None and title("나무법") is None and title(None) is None and title("나무법 (성춘향)") is None
    assert value(spark, bills.names_in(F.lit("성춘향, 이몽룡의원 외 5인, 성춘향/변 학도 위원장\n방자등 2인, A"))) == ["성춘향", "이몽룡", "변학도", "방자"]
    assert value(spark, bills.names_in(F.lit(None).cast("string"))) == []
    assert value(spark, bills.without_status(F.lit("진행 D-3  나무법 고침 입법예"))) == "나무법 고침"


def test_deadlines(spark):
    find = lambda t: value(spark, bills.deadline_in(F.lit(t).cast("string")))
    assert find("접수기간 2031.5.6 ~ 2031.6.7") == date(2031, 6, 7)
    assert find("접수기간 2031.6.7 ~ 2031.5.6") == date(2031, 5, 6) and find("접수마감 2031.6.7" + " x" * 40 + " 2031.8.9 ~") == date(2031, 6, 7)
    assert find("신청 마감: 2031년 2월 3일") == date(2031, 2, 3)
    assert find("공고일 2031.1.1") is None and find("") is None and find(None) is None


def test_packing(spark):
    pack = lambda a, i, r: value(spark, bills.packed(F.lit(a).cast("string"), F.lit(i).cast("string"), F.lit(r)))
    unpack = lambda t: tuple(value(spark, bills.unpacked(F.lit(t).cast("string"))))
    assert unpack(pack("do it", "matters", True)) == ("do it", "matters")
    assert unpack(pack("do it", "matters", False)) == ("do it", "")
    assert unpack(pack(None, "matters", True)) == ("", "matters")
    assert pack("do it", "", True) == "do it" and pack("", None, True) is None
    assert unpack(None) == ("", "") and unpack("old") == ("old", "")


def test_cards(spark):
    assert value(spark, bills.padded_lines(F.array(F.lit("a")), F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("c"), F.lit("d"))) == ["a", "b", "c"]
    assert value(spark, bills.excerpt(F.lit("One. Two acme. Three. Four."), ("acme",))) == "One. Two acme. Three."
    assert value(spark, bills.excerpt(F.lit("One."), ("acme",))) is None
    assert value(spark, bills.summary_header(F.lit("Daily"), F.lit(None).cast("string"))) == "[Daily]"
    assert value(spark, bills.echoes(F.lit("A bill on X"), F.lit("a BILL, on x!"))) is True
    assert value(spark, bills.echoes(F.lit("A bill"), F.lit("A bill that does much more than its title says"))) is False


def test_html_parsers(spark):
    docs = spark.createDataFrame([("s", "<table><tr><td>1<td><a href='/n/7'>T <b>x</b></a><td>Org (a)<td>2024.1.5 ~ 2024.2.1</tr><tr><td>no link</td></tr></table><script><a href='/n/9'>no</a></script>"), ("broken", "<table><tr><td><a href="), ("none", None)], "source string, content string")
    got = feeds.html_notices(docs, r"/n/(\d+)", "u://", agency=2, period=3).where("url = 'u://7'").collect()
    assert [(r.title, r.agency, r.notice_start, r.notice_end) for r in got] == [("T x", "Org", date(2024, 1, 5), date(2024, 2, 1))]
    index = spark.createDataFrame([("s", "<a href='/a/1'></a><a href='/a/2'>Two</a><a href='/a/1'>One</a><a href='/b'>No</a>")], "source string, content string")
    assert [(r.url, r.label) for r in feeds.article_links(index, "^/a/").orderBy("seq").collect()] == [("/a/1", "One"), ("/a/2", "Two")]


def test_a_failing_source_stops_no_other(spark):
    good = lambda: spark.createDataFrame([("u",)], "url string")
    rows, failed = feeds.all_sources([("a", good), ("b", lambda: spark.read.parquet("/no/such/path")), ("c", lambda: good().withColumn("title", F.lit("t")))])
    assert failed == ["b"] and sorted((r.label, r.title) for r in rows.collect()) == [("a", None), ("c", "t")]


def test_boilerplate(spark):
    body = "menu " * 10 + "Reason: the text"
    assert value(spark, feeds.without_boilerplate(F.lit(body), "Reason")) == "Reason: the text"
    assert value(spark, feeds.without_boilerplate(F.lit("Reason first then Reason"), "Reason")) == "Reason first then Reason"


def test_gate_over_micro_batches_is_the_gate_over_all(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 40}" if i % 9 else "", "good" if i % 4 else "bad") for i in range(200)], "seq long, url string, body string")
    for k in range(5):  # five files, a batch each
        rows.where(F.col("seq").between(40 * k, 40 * k + 39)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
    known = spark.createDataFrame([("u1",), ("u2",)], "url string")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw")
    relevant = F.col("body") == "good"
    for _ in range(2):  # the second run finds nothing new
        gate_stream.gated(stream, known, f"{tmp_path}/kept", f"{tmp_path}/ledger", relevant, f"{tmp_path}/state").awaitTermination()
        kept = spark.read.parquet(f"{tmp_path}/kept")
        assert kept.count() == kept.select("url").distinct().count()
        once = gate.staged(rows, known, known.where("false"), F.lit(True)).where("stage = 'kept'")
        off = {r.url for r in spark.read.parquet(f"{tmp_path}/ledger").collect()}
        assert {r.url for r in kept.collect()} | off == {r.url for r in once.collect()}
        assert kept.select("batch").distinct().count() > 1


def test_windows_over_micro_batches(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/events")
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")

    def run(rows, name, mode):
        windows.into_table(rows, f"{tmp_path}/{name}", f"{tmp_path}/{name}-state", mode).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = run(windows.daily_counts(stream(), "ts", "event_type", late="40 days"), "daily", "complete")
    want = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    first = run(windows.distinct_within(stream(), "ts", "user_id", "event_type", hours=2000), "distinct", "append")
    assert first.count() == events.select("user_id", "event_type").distinct().count()


def test_stores(spark):
    ledger = spark.createDataFrame([("a", "old", 1, 2)], "url string, reason string, first_seen long, hits long")
    seen = spark.createDataFrame([("a", "new", 5), ("b", "new", 6), ("b", "later", 7)], "url string, reason string, seen long")
    assert sorted(map(tuple, sinks.counted(ledger, seen).collect())) == [("a", "old", 1, 3), ("b", "new", 6, 2)]
    target = spark.createDataFrame([("a",)], "url string")
    assert sorted(r.url for r in sinks.new_rows(seen.select("url"), target, "url").collect()) == ["b"]


def test_feeds_cover_their_tables(spark):
    at = "/root/testdata/sf0.01"
    for name, of in (("rss_feeds", "documents"), ("xml_feeds", "orders")):
        found = catalogue.queries()[name](spark, at)
        assert found.count() == found.select("url").distinct().count() == spark.read.parquet(f"{at}/{of}.parquet").count()
        assert not compare.differences(found, compare.views(at), catalogue.oracle_sql()[name])


def test_a_feed_gives_its_first_items_alone(spark):
    feed = lambda k: f"<rss>{''.join(f'<item><title>t</title><link>{k}/{i:02}</link></item>' for i in range(25))}</rss>"
    rows = spark.createDataFrame([(k, feed(k)) for k in ("a", "b")], "source string, content string")
    assert sorted(r.url for r in feeds.rss_items(rows).collect()) == [f"{k}/{i:02}" for k in ("a", "b") for i in range(20)]
