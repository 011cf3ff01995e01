"""Literal cases of the functions and rules that the generated tables don't reach."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from newsloom import storage
from newsloom.functions import dates, jsonx, python_udfs
from newsloom.functions import text as X
from newsloom.operators import articles, gate, items, queue, rules, sinks, stats

DAY = date(2026, 9, 4)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        ("HTTPS://Ex.COM:443/a/?utm_source=x&b=2&a=1#f", "https://ex.com/a?a=1&b=2"),
        ("http://ex.com?fbclid=1", "http://ex.com/"),
        ("http://ex.com/a/b/", "http://ex.com/a/b"),
        ("no url", "no url"),
        ("", ""),
        (None, None),
    ],
)
def test_normal_url(spark, url, normal):
    assert value(spark, X.normal_url(F.lit(url).cast("string"))) == normal


@pytest.mark.parametrize(
    ("text", "day"),
    [("20260904", DAY), ("2026.09.04", DAY), ("2026/09/04", DAY), ("2026. 9. 4.", DAY), ("2026-13-01", None), ("", None), (None, None)],
)
def test_parse_date(spark, text, day):
    assert value(spark, dates.parse_date(F.lit(text).cast("string"))) == day


def test_parse_period(spark):
    got = value(spark, dates.parse_period(F.lit("2026. 9. 4. ~ 2026. 9. 11.")))
    assert (got.start, got.end) == (DAY, date(2026, 9, 11))
    one = value(spark, dates.parse_period(F.lit("until 2026-09-04")))
    assert (one.start, one.end) == (DAY, DAY)


@pytest.mark.parametrize(("days", "badge"), [(-1, "closed"), (0, "urgent"), (3, "urgent"), (4, "soon"), (7, "soon"), (8, "open"), (None, "none")])
def test_badge(spark, days, badge):
    end = F.date_add(F.lit(DAY), days) if days is not None else F.lit(None).cast("date")
    assert value(spark, dates.badge(end, DAY)) == badge


@pytest.mark.parametrize(("hour", "night"), [(22, False), (23, True), (0, True), (6, True), (7, False)])
def test_night_wraps_midnight(spark, hour, night):
    assert value(spark, dates.in_night(F.lit(hour), 23, 7)) is night
    for score, urgent, bypass in ((79, False, False), (80, False, False), (10, True, False), (10, True, True)):
        sends = score >= 80 or (urgent and bypass) if night else score >= 50 or urgent
        got = value(spark, queue.sendable(F.lit(hour), F.lit(score), F.lit(urgent), bypass))
        assert got == ("send" if sends else "wait")


@pytest.mark.parametrize(("age", "route"), [(5, "notify"), (6, "notify"), (71, "backfill"), (73, "stale"), (None, "no_pubdate")])
def test_fresh_route(spark, age, route):
    assert value(spark, gate.fresh_route(F.lit(age).cast("int"))) == route


def test_three_lines(spark):
    lines = value(spark, X.three_lines(F.lit("One. Two. Three. Four. Five.")))
    assert lines == ["One.", "Two.", "Three. Four. Five."]
    assert value(spark, X.three_lines(F.lit("2026 budget grows.\n- Next."))) == ["budget grows.", "Next."]
    assert value(spark, X.three_lines(F.lit("Seen from. 19.37.233.111\n2) Next."))) == ["Seen from.", "19.37.233.111", "Next."]
    assert value(spark, X.three_lines(F.lit(""))) == []


def test_json_recovery(spark):
    for text, got in (('```json\n{"a": "x"}\n```', "x"), ('so: {"a": "y"} done', "y"), ("[1, 2]", None), ("", None), (None, None)):
        found = value(spark, jsonx.recovered(F.lit(text).cast("string"), "a string", "a"))
        assert (found.a if found else None) == got
    for text, n in (('["a", "b"]', 2), ("", 0), ("nonsense", 0), (None, 0)):
        assert len(value(spark, jsonx.string_list(F.lit(text).cast("string")))) == n


def test_xml_rows(spark):
    rows = value(spark, jsonx.xml_rows(F.lit("<r><row><t> A </t><u><![CDATA[B]]></u></row><row><t></t></row></r>"), "row", ("t", "u")))
    assert [(r.t, r.u) for r in rows] == [("A", "B"), (None, None)]
    assert value(spark, jsonx.xml_rows(F.lit("<r><errorCode>1</errorCode><row><t>A</t></row></r>"), "row", ("t",))) == []


def test_chips(spark):
    chips = F.array(*map(F.lit, ("Acme Future", "acme-future", "ＡＣＭＥ　Future", "Other", "", "①", "1")))
    assert value(spark, X.distinct_chips(chips, F.array(F.lit("ＯTHER")))) == ["Acme Future", "①"]
    assert value(spark, X.distinct_chips(F.lit(None).cast("array<string>"), F.array(F.lit("a")))) is None


def test_normal_forms_fold_widths(spark):
    same = lambda a, b: value(spark, X.title_key(F.lit(a)) == X.title_key(F.lit(b)))
    assert same("ＡＢＣ 제목 ①", "abc 제목 1") and same("Plain title - Daily", "plain TITLE") and not same("abc", "abd")
    assert value(spark, X.normal_form(F.lit(None).cast("string"))) is None


def test_strings_without_callers_elsewhere(spark):
    assert value(spark, X.first_phrase(F.lit("금리 3.5% 인상 결정"))) == "금리 3.5% 인상 결정" and value(spark, X.first_phrase(F.lit("U.S. tariffs - rise. More"))) == "U.S" and value(spark, X.first_phrase(F.lit(" - One - two"))) == "One"
    assert value(spark, X.first_phrase(F.lit("x" * 70))) == "x" * 60 + "…"
    assert value(spark, X.masked(F.lit("key " + "0a" * 16 + " end"))) == "key *** end"
    assert value(spark, X.message(F.lit("a<b"), F.lit(None).cast("string"), F.lit("c&d"))) == "a&lt;b\nc&amp;d"
    assert value(spark, jsonx.clean_list(F.array(F.lit(" a "), F.lit(" "), F.lit("")))) == ["a"]
    assert value(spark, dates.status_of(F.lit(DAY), DAY)) == "open" and value(spark, dates.status_of(F.lit(date(2026, 9, 3)), DAY)) == "closed"
    assert value(spark, dates.status_of(F.lit(None).cast("date"), DAY)) == "open"
    for seconds, label in ((5, "now"), (90, "1 min"), (7200, "2 h"), (90000, "2026-09-04")):
        assert value(spark, dates.age_label(F.lit(seconds), F.lit(DAY).cast("timestamp"))) == label
    assert value(spark, X.three_lines(F.lit("a. " * 10_100)))[2].count("a.") == 10_098


def test_tags_close_with_their_own_bracket(spark):
    strip = lambda t: python_udfs.without_tag(t, ("note",))
    assert strip("（note (1)） Title") == "Title" and strip("[note (x] Title") == "Title" and strip("[note Title") == "[note Title"
    assert strip("(other) Title") == "(other) Title" and strip("[note][note 2] T") == "T"


@pytest.mark.parametrize(("text", "at"), [("2026-09-04T05:06:07Z", (2026, 9, 4, 5, 6, 7)), ("2026-09-04 05:06", (2026, 9, 4, 5, 6, 0)), ("2026-09-04T05:06:07+09:00", (2026, 9, 3, 20, 6, 7)), ("2026-09-04", (2026, 9, 4, 0, 0, 0)), ("soon", None), ("2026-13-04", None), (None, None)])
def test_parse_time(spark, text, at):
    got = value(spark, dates.parse_time(F.lit(text).cast("string")))
    assert (got.timetuple()[:6] if got else None) == at


def test_months(spark):
    assert value(spark, dates.month_of(F.lit("2026-02"), DAY)) == date(2026, 2, 1)
    for odd in ("2026-13", "soon", None):
        assert value(spark, dates.month_of(F.lit(odd).cast("string"), DAY)) == date(2026, 9, 1)
    assert value(spark, dates.month_shift(F.lit(date(2026, 12, 31)), 2)) == date(2027, 2, 1)


@pytest.mark.parametrize(("low", "high", "bounds"), [("80", "20", (20, 80)), ("-5", "250", (0, 100)), ("abc", None, (0, 0)), (50.9, 0, (50, 0)), ("nan", "inf", (0, 0))])
def test_score_bounds(low, high, bounds):
    assert articles.score_bounds(low, high) == bounds


def test_limits_of_rules():
    made = tuple(rules.Rule(f"r{k}", points, ("x",)) for k, points in enumerate([500, -500] + [1] * 40)) + (rules.Rule("empty", 5, ()),)
    kept = rules.within_limits(made)
    assert len(kept) == rules.MOST_RULES and [r.points for r in kept[:3]] == [100, -100, 1]


def test_swot_and_groups(spark):
    null = F.lit(None).cast("int")
    assert value(spark, rules.swot_total(F.lit(100), F.lit(0), F.lit(100), F.lit(0))) == 100
    assert value(spark, rules.swot_total(null, F.lit(100), null, null)) == 25 and value(spark, rules.swot_total(null, null, null, null)) is None
    assert value(spark, rules.swot_total(F.lit(1), null, null, null, F.lit(True))) is None
    groups = F.array(*map(F.lit, ("P", "S1", "unknown", "S1", "Q")))
    assert value(spark, rules.normal_groups(groups, {"P": ("S1", "S2"), "Q": ()})) == ["S1", "Q"]


def test_admission_reasons(spark):
    no, yes, old = F.lit(False), F.lit(True), F.lit(0)
    decide = lambda *a, **k: value(spark, queue.admission(*a, **k))
    assert decide(yes, yes, yes, no, old, no) == "excluded" and decide(no, yes, yes, no, old, no) == "suppressed"
    assert decide(no, no, yes, no, old, no) == "backfill" and decide(no, no, no, no, old, no) == "topic_off"
    assert decide(no, no, no, yes, F.lit(49), no) == "below" and decide(no, no, no, yes, F.lit(50), no) == "queued" == decide(no, no, no, yes, old, yes)
    assert decide(no, no, no, yes, old, no, topic=yes) == "queued"
    assert decide(no, no, no, yes, F.lit(99), no, published=F.lit(DAY), first_run=F.lit(date(2026, 9, 5))) == "before_first_run"
    for interest, required, title, match in ((("a",), ("b",), "a b", True), (("a",), (), "a b", False), (("a",), ("b",), "a", False)):
        assert value(spark, queue.topic_match(F.lit(title), interest, required)) is match
    assert value(spark, queue.topic_match(F.lit("a b c"), ("a",), ("b",), ("c",))) is False


def test_send_gate(spark):
    no, yes, now = F.lit(False), F.lit(True), F.lit(5)
    gate_of = lambda *a: value(spark, queue.send_gate(*a))
    assert gate_of(yes, yes, now, now, F.lit(12), F.lit(90), no) == "hold" and gate_of(no, yes, now, now, F.lit(12), F.lit(90), no) == "drop"
    assert gate_of(no, no, F.lit(6), now, F.lit(12), F.lit(90), no) == "skip" and gate_of(no, no, F.lit(None).cast("int"), now, F.lit(12), F.lit(90), no) == "send"


def test_a_recovery_lasts_until_it_is_calm(spark):
    rows = [(1, True, 99, 9, 9), (2, False, 5, 5, 5), (3, False, 99, 9, 9), (4, True, 50, 50, 50), (5, False, 50, 50, 50), (6, False, 1, 1, 1), (7, False, 99, 99, 99)]
    runs = spark.createDataFrame(rows, "ts int, quiet boolean, candidates int, fresh int, backlog int")
    assert [r.suppressed for r in queue.recovering(runs, "ts").orderBy("ts").collect()] == [True, True, False, True, True, True, False]


def test_slots_over_many_partitions(spark):
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("topic"), (F.col("id") * 37 % 101).alias("score"))
    got = queue.slots(rows, "topic", [F.desc("score"), F.col("event_id")]).collect()
    for topic in ("hot", "cold"):
        mine = sorted((r for r in got if r.topic == topic), key=lambda r: (-r.score, r.event_id))
        assert [r.turn for r in mine] == list(range(1, len(mine) + 1))


def test_gate_keeps_bodies_out_of_its_shuffles(spark, small):
    raw = spark.read.parquet(f"{small}/pages.parquet").select(F.col("page_id").alias("seq"), "url", "html")
    done = gate.staged(raw, raw.where("seq % 3 = 0"), raw.where("seq % 10 = 1"), F.contains("html", F.lit("the")))
    lines = [x for x in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if "html" in x]
    assert lines and all("passes" in x or "Relation" in x for x in lines), lines  # a body is read where it's judged, and goes no further
    hot = spark.createDataFrame([(k, "same" if k % 3 else None) for k in range(30)], "seq long, url string")
    found = gate.staged(hot, hot.limit(0), hot.limit(0), F.lit(True)).groupBy("stage").count().collect()
    assert dict(map(tuple, found)) == {"empty": 10, "kept": 1, "repeated": 19}


def test_filled_takes_one_value_a_key(spark):
    table = spark.createDataFrame([(1, None), (2, 5)], "k int, x int")
    values = spark.createDataFrame([(1, 9), (1, 7), (2, 1)], "k int, x int")
    assert sorted(map(tuple, sinks.filled(table, values, "k", "x").collect())) == [(1, 7), (2, 5)]


def test_a_shared_folder_is_asked_for_on_clusters():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    session = type("Session", (), {"conf": Conf, "sparkContext": Context})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(session)


@pytest.mark.parametrize(("agency", "clean"), [("O", "O"), ("예고  중", ""), ("12-3", ""), (" Ministry ", "Ministry"), (None, "")])
def test_clean_agency(spark, agency, clean):
    assert value(spark, X.clean_agency(F.lit(agency).cast("string"))) == clean


def test_first_rule_wins_and_all_match(spark):
    cat = {"a": ("x",), "b": ("x", "y")}
    assert value(spark, rules.first_category(F.lit("x y"), cat)) == "a"
    assert value(spark, rules.all_categories(F.lit("x y"), cat)) == ["a", "b"]
    assert value(spark, rules.first_category(F.lit("z"), cat)) == "other"


@pytest.mark.parametrize(
    ("level", "why", "sane"),
    [("medium", "it matters", "low"), ("high", "제3조", "high"), ("high", "see Article 3", "low"), ("odd", None, "none"), ("low", None, "low"), (None, None, "none")],
)
def test_sane_impact(spark, level, why, sane):
    assert value(spark, rules.sane_impact(F.lit(level).cast("string"), F.lit(why).cast("string"))) == sane


@pytest.mark.parametrize(
    ("impact", "title", "tier"),
    [("none", "word group", 2), ("low", "word", 2), ("low", "group", 3), ("medium", "word", 3), ("high", "", 3), ("", "", 1), ("", "group", 2)],
)
def test_priority(spark, impact, title, tier):
    row = spark.createDataFrame([(impact, title)], "impact string, title string")
    assert row.select(items.priority(("word",), ("group",)).alias("x")).first().x == tier


def test_scores_are_clamped(spark):
    for points, score in (((60, 60), 100), ((-15,), 0), ((), 0), ((20, 30), 50)):
        parts = F.array(*[F.struct(F.lit("l").alias("label"), F.lit(p).cast("long").alias("points")) for p in points]) if points else F.array().cast("array<struct<label:string,points:bigint>>")
        assert value(spark, rules.clamped(parts)) == score


@pytest.mark.parametrize(("plus", "minus", "colour"), [(9, 1, "positive"), (1, 9, "negative"), (6, 4, "neutral"), (0, 0, "none")])
def test_colour(spark, plus, minus, colour):
    assert value(spark, stats.colour(F.lit(plus), F.lit(minus))) == colour


def test_interleaving(spark):
    rows = spark.createDataFrame([(i, k) for i, k in enumerate("AAAAABBC")], "seq long, kind string")
    assert [r.kind for r in items.interleaved(rows, "kind", "seq", 6).collect()] == list("ABCABA")


def test_roster(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x")], "name string, party string")
    assert dict(map(tuple, stats.party_of(rows).collect())) == {"a": "", "b": "x"}


def test_python_string_functions(spark):
    rows = spark.createDataFrame([("&amp;lt;b&gt;", "[새 소식 [x]] Title", "Ａcme", "abcd", "abce"), (None, None, None, None, "x")], "a string, b string, c string, d string, e string")
    got = rows.select(python_udfs.unescape("a").alias("a"), python_udfs.strip_tag(("새 소식",))("b").alias("b"), python_udfs.nfkc("c").alias("c"), python_udfs.sequence_ratio("d", "e").alias("r")).collect()
    assert tuple(got[0]) == ("<b>", "Title", "Acme", 0.75)
    assert tuple(got[1]) == (None, None, None, None)


def test_suppressed_runs_across_days(spark):
    rows = spark.sql("select timestamp(x) as ts from values ('2024-01-01 00:00:00'), ('2024-01-01 00:10:00'), ('2024-01-01 23:50:00'), ('2024-01-02 00:05:00'), ('2024-01-05 00:00:00') as t(x)")
    got = [r.quiet for r in queue.suppressed_runs(rows, "ts").orderBy("ts").collect()]
    assert got == [True, False, True, False, True]
