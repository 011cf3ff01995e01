"""Queries of the source parsers and of the functions over titles and notices, on feeds made from the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import bills
from ..operators import dictionaries, rules, stats
from ..sources import feeds, html, snapshots
from ..sources.fixtures import table, view, with_views
from ..storage import fresh_path, written

QUERIES = {}


def _rss_feeds(s, d):
    """All documents as RSS texts, one for each range of 20 ids, as many as the parser takes of one feed. Titles and
    descriptions vary: escaped once or twice, with tags, without a link or a day."""
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<![CDATA[T "), "doc_id", F.lit("]]>"))).otherwise(F.concat(F.lit("T&amp;amp; "), "doc_id"))
    day = F.when(F.col("doc_id") % 4 == 0, "soon").otherwise("Mon, 05 Jan 2024 10:00:00 +0000")
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>http://h/"), "doc_id", F.lit("</link><description>&lt;b&gt;x&lt;/b&gt; &amp;amp; y</description><pubDate>"), day, F.lit("</pubDate></item>"))
    rows = table(s, d, "documents").select(F.concat(F.lit("f"), F.floor(F.col("doc_id") / 20)).alias("source"), F.struct("doc_id", item.alias("item")).alias("x"))
    return rows.groupBy("source").agg(F.concat(F.lit("<rss>"), F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]), ""), F.lit("</rss>")).alias("content"))


def _xml_feeds(s, d):
    """All items as XML texts, one for each item type and range of 300 ids, so that the parser takes all rows of one.
    Beside every ninth row stands one without a number, and beside the feeds one that is an error."""
    row = "<row><seq>%s</seq><nm> a  b </nm><org>o</org><st>20240105</st><en>2024. 2. 1.</en></row>"
    rows = F.concat(F.format_string(row, F.lpad(F.col("id").cast("string"), 9, "0")), F.when(F.col("id") % 9 == 0, F.format_string(row, F.lit(""))).otherwise(""))
    items = view(s, d, "items").select(F.concat("item_type", F.lit("/"), F.floor(F.col("id") / 300)).alias("source"), rows.alias("row"))
    texts = items.groupBy("source").agg(F.concat(F.lit("<l>"), F.array_join(F.sort_array(F.collect_list("row")), ""), F.lit("</l>")).alias("content"))
    return texts.unionByName(texts.select(F.concat("source", F.lit("?")).alias("source"), F.concat(F.lit("<errorCode>9</errorCode>"), "content").alias("content")))


QUERIES["rss_rows"] = QUERIES["rss_feeds"] = (
    lambda s, d: feeds.rss_items(_rss_feeds(s, d)).select("source", "url", "title", "body", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published")),
    "select 'f' || (doc_id // 20) as source, 'http://h/' || doc_id as url, case when doc_id % 3 = 0 then 'T ' else 'T& ' end || doc_id as title, 'x & y' as body, case when doc_id % 4 <> 0 then '2024-01-05 10:00' end as published from documents",
)
QUERIES["xml_notices"] = QUERIES["xml_feeds"] = (
    lambda s, d: feeds.xml_notices(_xml_feeds(s, d), "row", {"id": "seq", "title": "nm", "agency": "org", "start": "st", "end": "en"}, "n://"),
    with_views("select item_type || '/' || (id // 300) as source, 'n://' || lpad(id::varchar, 9, '0') as url, 'a b' as title, 'o' as agency, date '2024-01-05' as notice_start, date '2024-02-01' as notice_end from items", "items"),
)
QUERIES["json_bills"] = (
    lambda s, d: feeds.json_bills(
        table(s, d, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit('{"data": {"row": [{"BILL_ID": "'), F.col("n_nationkey"), F.lit('", "NM": "", "NAME": "bill", "END": "2024/03/0'), F.col("n_nationkey") % 9 + 1, F.lit('"}, {"NM": "no id"}]}}')).alias("content")),
        "data.row", {"id": ("BILL_ID",), "title": ("NM", "NAME"), "agency": ("ORG",), "end": ("END", "DUE"), "link": ("LINK",)}, "b://",
    ),
    "select n_name as source, 'b://' || n_nationkey as url, 'bill' as title, null::varchar as agency, date '2024-03-01' + (n_nationkey % 9)::int as notice_end from nation",
)
QUERIES["html_notices"] = (
    lambda s, d: feeds.html_notices(
        table(s, d, "supplier").select(F.lit("s").alias("source"), F.concat(F.lit("<table><tr><th>no</th></tr><tr><td>1</td><td><a href='/n/"), "s_suppkey", F.lit("?x=1'>Title &amp; more</a></td><td>Org (act)</td><td>2024. 1. 5. ~ 2024. 2. 1.</td></tr></table>")).alias("content")),
        r"/n/(\d+)", "h://", agency=2, period=3,
    ),
    "select 's' as source, 'h://' || s_suppkey as url, 'Title & more' as title, 'Org' as agency, date '2024-01-05' as notice_start, date '2024-02-01' as notice_end from supplier",
)
QUERIES["page_links"] = (
    lambda s, d: feeds.article_links(
        table(s, d, "nation").select(F.col("n_name").alias("source"), F.concat(F.lit("<a href='/a/1'> </a><a href='/b/9'>no</a><a href='/a/"), F.col("n_nationkey") + 2, F.lit("'>Two<b> words</b></a><script>var x = '<a>'</script><a href='/a/1'>a label that is far too long for one</a><a href='/a/1'>One</a>")).alias("content")), "^/a/"
    ).select("source", "url", "label", F.col("seq").cast("long").alias("seq")),
    "select n_name as source, '/a/1' as url, 'One' as label, 0::bigint as seq from nation union all select n_name, '/a/' || (n_nationkey + 2), 'Two words', 2 from nation",
)
QUERIES["links_of_pages"] = (
    lambda s, d: feeds.article_links(table(s, d, "pages").select(F.col("page_id").alias("source"), F.col("html").alias("content")), ".").groupBy("source").agg(F.count("*").alias("n")),
    "select page_id as source, n from (select page_id, len(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda x: x <> ''))) as n from pages) z where n > 0",
)
def _sponsor():
    return F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("법률안 (일부개정) (홍길동의원 등 "), F.col("n_nationkey") + 1, F.lit("인)"))).when(F.col("n_nationkey") % 6 == 1, "관세법 일부개정법률안(이몽룡의원 대표발의)").when(F.col("n_nationkey") % 6 == 2, "어떤 법 [성춘향 외 4인]").when(F.col("n_nationkey") % 6 == 3, "법률안 (전부개정)").when(F.col("n_nationkey") % 6 == 4, "법 (김아무개의원) (시행령 등 3인)")


QUERIES["sponsors"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", bills.sponsor_in(_sponsor()).alias("x")).select("n_nationkey", F.col("x.name").alias("name"), F.col("x.total").cast("long").alias("total")),
    "select n_nationkey, case n_nationkey % 6 when 0 then '홍길동' when 1 then '이몽룡' when 2 then '성춘향' end as name, case n_nationkey % 6 when 0 then n_nationkey + 1 when 1 then 1 when 2 then 4 end::bigint as total from nation",
)


def _sponsor_lists(s, d):
    n = F.col("n_nationkey")
    lead = F.when(n % 5 == 0, "홍길동의원").when(n % 5 == 1, "")
    others = F.when(n % 5 == 0, "이몽룡, 홍길동, 성춘향 외 3인")
    page = F.when(n % 5 == 1, F.array(F.lit("변학도"), F.lit("방자")))
    proposer = F.when(n % 5 == 2, "향단의원 등 12인")
    return table(s, d, "nation").select("n_nationkey", F.explode(bills.sponsors(lead, others, page, proposer, F.when(n % 5 == 3, "법 (월매의원 등 2인)").otherwise("법"))).alias("x")).select("n_nationkey", "x.name", "x.role")


ROSTER = [("홍길동", "가당"), ("이몽룡", "나당"), ("이몽룡", "다당"), ("향단", "나당")]
QUERIES["sponsors_with_party"] = (
    lambda s, d: _sponsor_lists(s, d).join(stats.party_of(s.createDataFrame(ROSTER, "name string, party string")), "name", "left").withColumn("party", F.coalesce("party", F.lit(""))).select("n_nationkey", "name", "role", "party"),
    """select n_nationkey, unnest(case n_nationkey % 5 when 0 then ['홍길동', '이몽룡', '성춘향'] when 1 then ['변학도', '방자'] when 2 then ['향단'] when 3 then ['월매'] else []::varchar[] end) as name, unnest(case n_nationkey % 5 when 0 then ['대표', '공동', '공동'] when 1 then ['대표', '공동'] when 4 then []::varchar[] else ['대표'] end) as role,
unnest(case n_nationkey % 5 when 0 then ['가당', '', ''] when 1 then ['', ''] when 2 then ['나당'] when 3 then [''] else []::varchar[] end) as party from nation""",
)
QUERIES["law_names"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", bills.law_name(F.when(F.col("n_nationkey") % 4 == 0, F.concat("n_name", F.lit("법 일부개정법률안 입법예고"))).when(F.col("n_nationkey") % 4 == 1, F.concat("n_name", F.lit(" 시행령안"))).when(F.col("n_nationkey") % 4 == 2, "제정안").otherwise(F.col("n_name"))).alias("law")),
    "select n_nationkey, case n_nationkey % 4 when 0 then n_name || '법' when 1 then n_name || ' 시행' when 2 then '제정안' else n_name end as law from nation",
)
#: Authors and titles, and the agency of each.
BY = [
    ("환경부", "x", "기후에너지환경부"), ("길동 기자", "국토부, 새 계획", "국토교통부"), (None, "기상청은 오늘 알림", "기상청"), ("", "그 밖의 일", ""), (None, "정부는 오늘 발표", ""), (None, "내부 문건", ""), ("KOTRA", "x", "KOTRA"),
    (None, "산업통상자원부가 연 회의", "산업통상부"), (None, "  공정위 , 조사", "공정거래위원회"), (None, "국토부", ""), ("아주아주긴이름의어떤진흥원", "문체부 알림", "문화체육관광부"), (None, "한국부동산원 조사", ""), (None, None, ""), (None, "the 국토부 x", ""),
]
QUERIES["article_agencies"] = (
    lambda s, d: table(s, d, "customer").select("c_custkey", F.get(F.array(*[F.struct(F.lit(a).cast("string").alias("a"), F.lit(t).cast("string").alias("t")) for a, t, _ in BY]), (F.col("c_custkey") % len(BY)).cast("int")).alias("x")).select("c_custkey", bills.agency_of_article(F.col("x.a"), F.col("x.t")).alias("agency")),
    "select c_custkey, [" + ", ".join(f"'{g}'" for _, _, g in BY) + f"][c_custkey % {len(BY)} + 1] as agency from customer",
)
QUERIES["actions_packed"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", bills.packed(F.when(F.col("n_nationkey") % 2 == 0, "act"), F.when(F.col("n_nationkey") % 3 == 0, "watch"), F.col("n_nationkey") % 5 != 0).alias("text")).select("n_nationkey", "text", bills.unpacked(F.col("text"))["action"].alias("action"), bills.unpacked(F.col("text"))["implication"].alias("implication")),
    "select n_nationkey, nullif(concat_ws(chr(10), a, case when n_nationkey % 5 = 0 then '[시사점] -' when w <> '' then '[시사점] watch' end), '') as text, coalesce(a, '') as action, case when n_nationkey % 5 = 0 then '' else w end as implication from (select *, case when n_nationkey % 2 = 0 then 'act' end as a, case when n_nationkey % 3 = 0 then 'watch' else '' end as w from nation) z",
)
QUERIES["deadlines_in_text"] = (
    lambda s, d: table(s, d, "nation").select("n_nationkey", bills.deadline_in(
        F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("공고일 2025.1.1 접수기간 2024.3.1 ~ 2024.4."), F.col("n_nationkey") + 1, F.lit(" 18:00")))
        .when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("신청 2024년 4월 "), F.col("n_nationkey") + 1, F.lit("일까지. 마감 2024-03-02")))
        .when(F.col("n_nationkey") % 4 == 2, F.concat(F.lit("제출: 2024.4."), F.col("n_nationkey") + 1, F.lit(" ~ 2024.3.1")))
    ).alias("deadline")),
    "select n_nationkey, case when n_nationkey % 4 < 2 then date '2024-04-01' + n_nationkey::int when n_nationkey % 4 = 2 then date '2024-03-01' end as deadline from nation",
)

# --- lists and pages of single sources -----------------------------------------------------------------------------------


def _nation_pages(s, d, *parts):
    return table(s, d, "nation").select(F.col("n_name").alias("source"), F.lit(1).alias("page"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("content"))


def _k():
    return F.col("n_nationkey")


QUERIES["bill_rows"] = (
    lambda s, d: html.bill_notices(
        _nation_pages(s, d, "<table><tr><th>no</th></tr><tr><td>1</td><td onclick='go(7", _k(), ")'>진행 관세법 일부개정법률안 2200123 (x)</td><td>-</td><td>", F.when(_k() % 2 == 0, "Committee").otherwise(""), "</td><td>", F.when(_k() % 3 == 0, "2024.1.5 ~ 2024.1.15").otherwise("soon"), "</td></tr></table>"),
        r"go\((\d+)\)", "p://", date(2024, 1, 10), agency="House",
    ),
    "select n_name as source, 'p://7' || n_nationkey as url, '관세법 일부개정법률안' as title, '관세법' as law_name, case when n_nationkey % 2 = 0 then 'Committee' else 'House' end as agency, case when n_nationkey % 3 = 0 then date '2024-01-05' end as notice_start, case when n_nationkey % 3 = 0 then date '2024-01-15' end as notice_end, 'open' as status, n_nationkey % 3 <> 0 as deadline_missing from nation",
)
QUERIES["press_releases"] = (
    lambda s, d: html.press_releases(
        _nation_pages(s, d, "<a href='/r?id=", _k() + 100, "'><strong>", F.when(_k() % 2 == 0, "(참고 (1)) Head").otherwise(""), "</strong><span class='lead'>First part. More ···</span><span>2024.01.0", _k() % 9 + 1, "</span><span>Office</span></a><a href='/r?id=", _k() + 100, "'>again</a><a href='/x'>no</a>")
        .unionByName(_nation_pages(s, d, "<a href='/r?id=", _k() + 200, "'><strong>Old</strong>x 2023.12.01 Bureau</a>").withColumn("page", F.lit(2)))
        .unionByName(_nation_pages(s, d, "<a href='/r?id=", _k() + 300, "'><strong>Never</strong><span>2023.11.01</span></a>").withColumn("page", F.lit(3))),
        r"id=(\d+)", "r://", date(2024, 1, 1), ("참고",), "Unknown",
    ),
    "select n_name as source, 'r://' || (n_nationkey + 100) as url, case when n_nationkey % 2 = 0 then 'Head' else 'First part' end as title, n_nationkey % 2 <> 0 as title_missing, 'First part. More' as body, date '2024-01-01' + (n_nationkey % 9)::int as notice_start, 'Office' as agency from nation union all select n_name, 'r://' || (n_nationkey + 200), 'Old', false, '', date '2023-12-01', 'Bureau' from nation",
)
QUERIES["trade_rows"] = (
    lambda s, d: feeds.trade_news(
        _nation_pages(s, d, '{"response": {"header": {"resultCode": "', F.when(_k() % 7 == 0, "99").otherwise("00"), '"}, "body": {"itemList": ', F.when(_k() % 3 == 0, F.concat(F.lit('{"item": {"title": "Steel &amp;amp; more", "nation": "X'), _k(), F.lit('", "industry": "metal", "info": "n", "id": "'), _k(), F.lit('", "published": "2024-02-03"}}'))).when(_k() % 3 == 1, F.concat(F.lit('{"item": [{"title": "Tariff of X'), _k(), F.lit('", "nation": "X'), _k(), F.lit('", "info": "rules", "url": "u://1", "published": "20240204"}, {"title": "Sport", "id": "5"}]}'))).otherwise('[{"title": "Battery", "id": "8", "office": "O"}, {"title": "", "id": "9"}]'), "}}}"),
        "t://", "Trade", lambda industry, info, title: rules.trade_relevant(industry, info, title, ("metal",), ("rules",), ("Battery",)),
    ),
    """select n_name as source, case n_nationkey % 3 when 0 then 't://' || n_nationkey when 1 then 'u://1' else 't://8' end as url, case n_nationkey % 3 when 0 then '[X' || n_nationkey || '] Steel & more' when 1 then 'Tariff of X' || n_nationkey else 'Battery' end as title, 'Trade' as agency, case n_nationkey % 3 when 0 then date '2024-02-03' when 1 then null end as notice_start,
case n_nationkey % 3 when 0 then 'Steel & more (X' || n_nationkey || ' · metal) n' when 1 then 'Tariff of X' || n_nationkey || ' (X' || n_nationkey || ' · ) rules' else 'Battery O' end as body from nation where n_nationkey % 7 <> 0""",
)
QUERIES["webzine_pages"] = (
    lambda s, d: html.articles(
        _nation_pages(s, d, "<html><head><meta name='description' content=' Lead  text'><meta property='og:image' content='i", _k(), ".png'><meta property='og:title' content='Meta'></head><div class='top'><b class='main'>", F.when(_k() % 2 == 0, "A &amp; B").otherwise(""), "</b><i class='sub'>S</i></div><p class='cat'>Issue World news</p><div class='text big'>", F.when(_k() % 3 == 0, "<p>One</p><p> </p><p>Two<script>x</script></p>").otherwise(""), "</div>").withColumn("url", F.col("source")),
        "main", "sub", "cat", "text",
    ),
    "select n_name as source, n_name as url, case when n_nationkey % 2 = 0 then 'A & B' else 'Meta' end as title, 'S' as sub, 'World news' as category, 'i' || n_nationkey || '.png' as thumbnail, case when n_nationkey % 3 = 0 then 'One' || chr(10) || 'Two' else 'Lead text' end as body from nation",
)
QUERIES["release_bodies"] = (
    lambda s, d: _nation_pages(s, d, "<meta name='description' content='", F.when(_k() % 2 == 0, "Head - ").otherwise("Other - "), "the  text'>").select("source", html.release_body("content", F.lit("Head")).alias("body")),
    "select n_name as source, 'the text' as body from nation",
)
CALLS = {"title": "Title", "day": "Day", "department": "Dept", "files": "Files"}


def _grants(s, d):
    """The union of the sources of calls; one that fails is left out."""
    labelled = _nation_pages(s, d, "<table><tr><td data-label='Title'><a href='g://1", _k(), "?p=1'>Call</a></td><td data-label='Dept'>D1</td><td data-label='Day'>", F.when(_k() % 2 == 0, "2024-03-04").otherwise("soon"), "</td><td data-label='Files'><a href='1'>a</a><a href='2'>b</a><a href='3'>c</a><a href='4'>d</a></td></tr><tr><td data-label='Title'>no link</td></tr></table>")
    plain = _nation_pages(s, d, "<table><tr><td>9</td><td><a href='board?id=", _k(), ";s=1'>Notice</a></td><td>", F.when(_k() % 2 == 0, "1,024").otherwise("D2"), "</td><td>2024-03-05</td></tr></table>")
    rendered = _nation_pages(s, d, "<table><tr", F.when(_k() % 2 == 0, F.concat(F.lit(" onclick='see(55"), _k(), F.lit(")'"))).otherwise(""), "><td>title : Bid ", _k(), "</td><td>2024.03.06</td><td>", F.when(_k() % 5 == 0, "2024-01-01").when(_k() % 5 == 1, "").otherwise("2024-12-31 18:00"), "</td><td>method: open</td></tr></table>")
    listed = _nation_pages(s, d, '{"list": [{"id": "', _k(), '", "title": " A  call ", "agency": "", "office": "O", "opens": "20240307", "closes": "', F.when(_k() % 2 == 0, "2024.04.01 18:00").otherwise(""), '"}, {"title": "no id"}], "paging": {"page": 1, "pages": "', F.when(_k() % 2 == 0, "1").otherwise("2"), '"}}')
    return feeds.all_sources([
        ("labelled", lambda: html.grants_by_label(labelled, CALLS, "data-label", "M1")),
        ("plain", lambda: html.grants_by_place(plain, r"id=(\d+)", "m://", "M2")),
        ("broken", lambda: labelled.select("no_such_column")),
        ("bids", lambda: html.bids(rendered, "b://", date(2024, 2, 1), "M3")),
        ("listed", lambda: feeds.json_grants(listed, "list", "l://", "Several")),
    ])


QUERIES["grant_calls"] = (
    lambda s, d: _grants(s, d)[0].select("label", "source", "url", "title", "agency", "department", "notice_start", "notice_end", "body", F.array_join("attachment_urls", "|").alias("files"), "method", "detail_needed", "last_page"),
    """select 'labelled' as label, n_name as source, 'g://1' || n_nationkey as url, 'Call' as title, 'M1' as agency, 'D1' as department, case when n_nationkey % 2 = 0 then date '2024-03-04' end as notice_start, null::date as notice_end, null as body, '1|2|3' as files, null as method, null::boolean as detail_needed, null::boolean as last_page from nation
union all select 'plain', n_name, 'm://' || n_nationkey, 'Notice', 'M2', case when n_nationkey % 2 = 0 then '' else 'D2' end, date '2024-03-05', null, null, null, null, null, null from nation
union all select 'bids', n_name, 'b://' || case when n_nationkey % 2 = 0 then '55' || n_nationkey else 'h' || substr(sha1('Bid ' || n_nationkey || '2024-03-06'), 1, 10) end, 'Bid ' || n_nationkey, 'M3', null, date '2024-03-06', case when n_nationkey % 5 > 1 then date '2024-12-31' end, concat_ws(' · ', 'Bid ' || n_nationkey, 'open', '', case when n_nationkey % 5 > 1 then '2024-12-31' else '?' end), null, 'open', null, null from nation where n_nationkey % 5 <> 0
union all select 'listed', n_name, 'l://' || n_nationkey, 'A call', 'Several', 'O', date '2024-03-07', case when n_nationkey % 2 = 0 then date '2024-04-01' end, 'A call · O · 2024-03-07 ~ ' || case when n_nationkey % 2 = 0 then '2024-04-01' else '?' end, null, null, n_nationkey % 2 <> 0, n_nationkey % 2 = 0 from nation""",
)
QUERIES["grant_relevance"] = (
    lambda s, d: view(s, d, "items_full").groupBy(rules.relevant(F.col("title"), F.col("law_name"), ("BRASS",), ("TIN",), F.col("item_type") == "grant_notice", ("SMALL",)).alias("relevant"), "item_type").agg(F.count("*").alias("n")),
    with_views("select case when item_type = 'grant_notice' then contains(title, 'BRASS') or contains(title, 'TIN') or contains(title, 'SMALL') else contains(title || ' ' || coalesce(law_name, ''), 'BRASS') or contains(title || ' ' || coalesce(law_name, ''), 'TIN') end as relevant, item_type, count(*) as n from items_full group by 1, 2", "items_full"),
)
QUERIES["rule_impacts"] = (
    lambda s, d: view(s, d, "items_full").select(rules.rule_impact(F.col("title"), {"high": ("BRASS",), "medium": ("STEEL", "BRASS")}, {"high": "named", "medium": "close", "none": "far"}, "look").alias("x")).groupBy("x.level", "x.rationale", "x.action").agg(F.count("*").alias("n")),
    with_views("select level, case level when 'high' then 'named' when 'medium' then 'close' else 'far' end as rationale, case when level <> 'none' then 'look' end as action, count(*) as n from (select case when contains(title, 'BRASS') then 'high' when contains(title, 'STEEL') then 'medium' else 'none' end as level from items_full) z group by 1", "items_full"),
)
QUERIES["analyses_sane"] = (
    lambda s, d: view(s, d, "analyses_full").select(rules.sane_analysis(F.when(F.col("l_linenumber") == 1, "odd").otherwise(F.upper("impact_level")), F.col("impact_rationale"), F.lit(" note "), F.col("l_partkey") % 2 == 0, "not cited", "nothing", rules.ENGLISH_CITATION).alias("x")).groupBy("x.level", "x.rationale", "x.implication").agg(F.count("*").alias("n")),
    with_views("select level, case when impact_rationale is not null then impact_rationale when l in ('high', 'medium') then 'not cited' else 'nothing' end as rationale, case when level <> 'none' and l_partkey % 2 = 0 then 'note' else '' end as implication, count(*) as n from (select *, case when l = 'odd' then 'none' when l in ('high', 'medium') and coalesce(impact_rationale, '') <> 'Article 3 applies' then 'low' else l end as level from (select *, case when l_linenumber = 1 then 'odd' else impact_level end as l from analyses_full) y) z group by 1, 2, 3", "analyses_full"),
)
QUERIES["placeholders_due"] = (
    lambda s, d: view(s, d, "items_full").select("item_type", rules.placeholder(F.col("item_type"), F.col("title"), ("bill", "legislation", "admin_notice"), "no text yet", "not judged").alias("x")).groupBy("item_type", "x.summary").agg(F.count("*").alias("n")),
    with_views("select item_type, case when item_type in ('bill', 'legislation', 'admin_notice') and length(trim(title)) < 40 then 'no text yet' end as summary, count(*) as n from items_full group by 1, 2", "items_full"),
)
QUERIES["swot_parts"] = (
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == k + 1, F.col("l_quantity").cast("int") * 2)).alias(n) for k, n in enumerate("swot")]).select(
        "l_orderkey", rules.swot_total(*map(F.col, "swot"), F.col("l_orderkey") % 5 == 0).alias("total"), F.array_join(F.transform(rules.swot_top(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("score"), F.lit("t").alias("text")) for n in "swot"])), lambda x: x["name"]), "").alias("top")
    ),
    """with q as (select l_orderkey, max(case when l_linenumber = 1 then floor(l_quantity)::int * 2 end) as s, max(case when l_linenumber = 2 then floor(l_quantity)::int * 2 end) as w, max(case when l_linenumber = 3 then floor(l_quantity)::int * 2 end) as o, max(case when l_linenumber = 4 then floor(l_quantity)::int * 2 end) as t from lineitem group by 1),
e as (select l_orderkey, unnest(['s', 'w', 'o', 't']) as name, unnest([s, w, o, t]) as score, unnest([0, 1, 2, 3]) as i from q),
r as (select l_orderkey, name, row_number() over (partition by l_orderkey order by score desc, i) as rn from e where score >= 31)
select q.l_orderkey, case when q.l_orderkey % 5 <> 0 and coalesce(s, w, o, t) is not null then round((coalesce(s, 0) + coalesce(o, 0) - coalesce(w, 0) - coalesce(t, 0) + 200) / 4)::bigint end as total, coalesce((select string_agg(name, '' order by rn) from r where r.l_orderkey = q.l_orderkey and rn <= 3), '') as top from q""",
)


def _notice_pages(s, d):
    """Three pages a source: a full one of ten rows, a short one of nine, and one that isn't reached any more."""
    row = lambda k: F.concat(F.lit("<tr><td>1</td><td><a href='/n/"), F.lit(k) + _k() * 100, F.lit("?x=1'>T</a></td><td>Org (act)</td><td>2024. 1. 5. ~ 2024. 1. "), _k() + 1, F.lit(".</td></tr>"))
    pages = [_nation_pages(s, d, "<table>", *[row(10 * p + k) for k in range(n)], "</table>").withColumn("page", F.lit(p)) for p, n in ((1, 10), (2, 9), (3, 10))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


QUERIES["notice_pages"] = (
    lambda s, d: feeds.paged_notices(_notice_pages(s, d), r"/n/(\d+.*)", "h://", 2, 3, date(2024, 1, 10)).drop("page"),
    "select n_name as source, 'h://' || (10 * p + k + n_nationkey * 100) as url, 'T' as title, 'Org' as agency, date '2024-01-05' as notice_start, make_date(2024, 1, n_nationkey + 1) as notice_end, case when n_nationkey + 1 < 10 then 'closed' else 'open' end as status from nation, (select unnest([1, 2]) as p), (select unnest(range(10)) as k) where p = 1 or k < 9",
)


def _snapshots(s, d):
    """The documents as snapshots of their sources, of which the first by name can't be read."""
    docs = table(s, d, "documents")
    first = docs.agg(F.min("source").alias("first"))
    item = F.to_json(F.struct(F.substring(F.translate("text", "\n\r", "  "), 1, 40).alias("title"), F.col("doc_id").cast("string").alias("link")))
    rows = docs.where("source is not null").crossJoin(F.broadcast(first)).select("source", F.when(F.col("source") == F.col("first"), "no item").otherwise(item).alias("value"))  # first is one row
    path = fresh_path(s, "snapshots")
    rows.write.partitionBy("source").text(path)
    return snapshots.load(s, path)


def feeds_by_source(s, d):
    """Every item, and a row for each source that couldn't be read."""
    rows = _snapshots(s, d)
    failed = rows.where("error is not null").select("source").distinct()
    return rows.where("error is null").select("source", "link", "title", F.lit(False).alias("failed")).unionByName(failed.withColumn("failed", F.lit(True)), allowMissingColumns=True)


QUERIES["feeds_by_source"] = (
    feeds_by_source,
    """select source, doc_id::varchar as link, substr(translate(text, chr(10) || chr(13), '  '), 1, 40) as title, false as failed from documents where source > (select min(source) from documents)
union all select min(source), null, null, true from documents""",
)
#: A dictionary from the tables: words of the benchmark, parts, customers and suppliers.
DICTIONARY = "select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as term from benchmark union select lower(p_name) from part union select lower(c_name) from customer union select lower(s_name) from supplier"


def _dictionary(s, d):
    words = table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))
    for name, column in (("part", "p_name"), ("customer", "c_name"), ("supplier", "s_name")):
        words = words.unionByName(table(s, d, name).select(F.lower(column).alias("term")))
    return words.distinct().select(F.pmod(F.xxhash64("term"), F.lit(1 << 62)).alias("term_id"), "term")


def _dictionary_hits(s, d):
    terms = written(_dictionary(s, d), "dictionary")
    found = dictionaries.with_terms(table(s, d, "documents").select("doc_id", F.lower("text").alias("text")), terms, keep_text=False)
    each = found.select("doc_id", F.explode_outer("term_ids").alias("term_id")).hint("merge").join(terms.hint("merge"), "term_id", "left")
    return each.groupBy("doc_id").agg(F.count("term").alias("n_terms"), F.md5(F.array_join(F.sort_array(F.collect_list("term")), "|")).alias("digest"))


QUERIES["dictionary_hits"] = (
    _dictionary_hits,
    f"with t as ({DICTIONARY}), h as (select doc_id, term from documents left join t on contains(lower(text), term)) select doc_id, count(term) as n_terms, md5(coalesce(array_to_string(list_sort(list(term) filter (term is not null)), '|'), '')) as digest from h group by 1",
)
