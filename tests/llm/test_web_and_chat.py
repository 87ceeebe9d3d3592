import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lotweave.llm import chat_format, html_text, language, rollups, warc
from lotweave.llm.common import scratch_path
from lotweave.llm.queries import ORACLES, QUERIES

PAGES = "page_id bigint, url string, html string, digest string, shard string"


def test_archives_round_trip(spark):
    long = "x" * 150
    rows = [(3, "http://a/3", long), (1, "http://a/1", long), (2, None, "short"), (4, "http://a/4", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "é\n", "é" * 60), (1, "http://a/1", long)]
    pages = spark.createDataFrame([(*r, "d", "s") for r in rows], PAGES)
    folder = scratch_path(spark, "warc-test")
    made = warc.write(pages, folder, shard_bytes=300, file_bytes=400)
    assert made.agg(F.sum("records")).first()[0] == len(rows) and made.count() > 2
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read(spark, folder).collect()), key=str)
    want = []
    for k, _, html in rows:
        body = (html or "").encode()
        revisit = html == long and k != 1
        want.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None, None if revisit else bytearray(body)))
    assert got == sorted(want, key=str)
    again = scratch_path(spark, "warc-test")
    files = lambda m: sorted((r["file"], r["sha256"]) for r in m.collect())
    assert files(warc.write(pages.repartition(5), again, shard_bytes=300, file_bytes=400)) == files(made)


def test_archives_of_an_empty_table(spark):
    folder = scratch_path(spark, "warc-test")
    assert warc.write(spark.createDataFrame([], PAGES), folder).count() == 0 and warc.read(spark, folder).count() == 0


def test_members_are_read_without_copying_the_rest(monkeypatch):
    data = [b"%d " % i + hashlib.sha512(b"%d" % i).digest() * (i % 300) for i in range(500)]
    whole, copied, plain = b"".join(warc.member(d) for d in data), [], warc.zlib.decompressobj

    class Watched:
        def __init__(self, bits):
            self.inner = plain(bits)

        def __getattr__(self, name):
            value = getattr(self.inner, name)
            if name == "unused_data":
                copied.append(len(value))
            return value

    monkeypatch.setattr(warc.zlib, "decompressobj", Watched)
    assert list(warc.members(whole)) == data and len(whole) > 4 * warc.PIECE_BYTES
    assert max(copied) <= warc.PIECE_BYTES


def test_damaged_record_is_refused():
    raw = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None, 5)
    assert warc.parse(raw)[1].endswith(b"hello")
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"hello", b"hullo"))


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain 1 < 2 &amp; 3", "plain 1 < 2 & 3"),
    ("<p>One<p>Two<br>three<div>four</div>", "One\n\nTwo\nthree\n\nfour"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
    ("<table><tr><th>Name<th>n<tr><td>fig<td>12<td>x</table>", "Name  n\nfig   12  x"),
    ("<table><tr><td>a<table><tr><td>in</table><td>b</table>", "a   b\n\nin"),
    ("<div hidden>no</div><b style='Display: None'>no</b><script>if (a</b>) x='</p>'</script>yes<style>p{}</style>", "yes"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("</p></b>x</div>y", "xy"), ("<p title='a>b'>in</p><!-- no --><![CDATA[no]]>", "in"),
    ("<a href=\"x>open quote</a>tail", "open quotetail"), ("<textarea> keep <b> </textarea>", "keep <b>"),
])
def test_rendered_text(html, text):
    assert html_text.render(html) == text


def test_rendering_deep_and_long_pages():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert len(html_text.render("<td>y " * 20_000)) >= 20_000
    assert html_text.render("<table><tr><td>" * 2_000 + "z").strip() == "z"


def test_extract_gives_a_row_per_page(spark):
    pages = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, "t")], "page_id bigint, html string, text string")
    assert sorted(str(tuple(r)) for r in html_text.extract(pages).collect()) == ["(1, 'a')", "(1, 'a')", "(None, '')"]


def test_chat_round_trip_with_parts(spark):
    hard = "<turn> </turn>\n <\\turn> <\\\\/turn> <part image 1> \\### Assistant: </turn> ok"
    part = lambda kind, text=None, uri=None, amount=None: (kind, text, uri, amount)
    rows = [(1, 0, "user", [part("text", hard), part("image", None, "s/1", 4), part("text", "mid"), part("audio", None, "s/2", 10)]), (1, 1, "assistant", [part("text", hard)]),
            (1, 2, "user", [part("document", None, "s/3", None)]), (2, 0, None, [part("text", None)]), (None, 5, "assistant", [part("text", "")])]
    made = chat_format.format_chats(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>"))
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert [t["text"] for t in got[1]["turns"]][1] == hard and got[1]["learned"] == [hard]
    assert got[1]["turns"][0]["text"] == hard + "<part image 1>mid<part audio 2>" and got[1]["turns"][2]["text"] == "<part document 3>"
    assert [tuple(a) for a in got[1]["attachments"]] == [(1, "image", "s/1", 1024), (2, "audio", "s/2", 250), (3, "document", "s/3", 512)]
    assert got[1]["expanded_tokens"] == 1786 and got[2]["turns"][0] == ("", "") and got[None]["learned"] == [""]


def test_chat_query_matches_its_sql_on_odd_rows(spark, tmp_path):
    """Roles with line breaks and control strings, ties, repeats, nulls, long texts, clashing names."""
    rows = [(1, 0, "us\ner", "a"), (1, 0, "us\ner", "a"), (1, 1, "<line>", "b<line>"), (1, 1, "<\\line>\n", "c"), (1, 2, "<turn>\n</turn>", "</turn>\n<part "),
            (2, 0, "assistant", 'b"'), (2, 0, "assistant", "b#"), (2, 0, "assistant", "b!"), (2, 0, "assistant", "b\\"), (2, 1, None, "z"), (2, 1, "", "y"),
            (3, None, "assistant", None), (3, 0, None, None), (4, 0, "assistant", "long <turn> " * 50_000), (None, 0, "user", "alone")]
    (tmp_path / "x").mkdir()
    frame = spark.createDataFrame([(*r, "p", "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, place string, parts string")
    frame.write.parquet(f"{tmp_path}/x/conversations.parquet")
    got = QUERIES["op6_chat_formatting"](spark, f"{tmp_path}/x").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/x/conversations.parquet/*.parquet')")
    want = con.execute(ORACLES["op6_chat_formatting"]).df()[list(got.columns)]
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).replace({float("nan"): None}).itertuples(index=False, name=None)))
    got["conv_id"], want["conv_id"] = got["conv_id"].astype("Int64").astype(str), want["conv_id"].astype("Int64").astype(str)
    assert key(got) == key(want) and len(got) == 6


def test_chats_of_an_empty_table(spark):
    none = spark.createDataFrame([], f"conv_id bigint, turn bigint, role string, parts array<{chat_format.PART}>")
    assert chat_format.read_back(chat_format.format_chats(none)).count() == 0


@pytest.mark.parametrize("page,want", [
    ("<html><head><title>T</title><body><p>Hello</p>", "Hello"),
    ("<html><head><title>T</title><meta charset=utf-8><p>Hello<p>again</html>", "Hello\n\nagain"),
    ("<head><style>x</style> \n <script>y</script>Hello <b>you</b>", "Hello you"),
    ("<head><title>T</title>&nbsp;Hello</head><body>there", "\xa0Hello\nthere"),
    ("<head><template><p>no</p></template><title>T</title><head><x-y>Hello</x-y></head>there", "Hellothere"),
    ("<head><title>T</title></body>Hello", "Hello"),
    ("<html><head><title>T</title></head><p>Hello", "Hello")])
def test_head_without_an_end_tag(page, want):
    assert html_text.render(page) == want


@pytest.mark.parametrize("page,want", [
    ("<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation encoding=tex>no</annotation></math>.", "Let x=1 2 ."),
    ("<svg><title>no</title><desc>no</desc><style>no</style><path d='M0' style='display:none'/><text>North</text><text>So<tspan>uth</tspan></text><title/></svg>end", "North\nSouth\nend"),
    ("<svg><text><![CDATA[a < b & c]]></text><metadata>no</metadata><foreignObject><p>In</p></foreignObject></svg>", "a < b & c\n\nIn"),
    ("<svg style='display:none'><symbol><text>no</text><p>out", "out"),
    ("<label>City <select><option>Bonn<option selected>Kiel</select></label> go", "City\nBonn\nKiel\ngo"),
    ("<select><optgroup hidden><option>no<optgroup><option>yes</select>", "yes"),
    ("<object data=a.swf><param name=x><p>Fallback</p></object><noscript>No <b>scripts</b></noscript><canvas>no</canvas>", "Fallback\n\nNo scripts"),
    ("<div style='visibility: hidden'>no<b style='visibility:visible'>yes<i style='visibility:hidden'>no</i></b></div>", "yes"),
    ("<div style='display:none'>no<b style='visibility:visible'>no</b></div><desc>yes</desc>", "yes"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes")])
def test_all_that_readers_see(page, want):
    assert html_text.render(page) == want


def test_language_evidence(spark):
    known = spark.createDataFrame([("de", "der die das und nicht"), ("en", "the and of with that")] * 30 + [(None, "x"), ("en", None)], "lang string, text string")
    names, table = language.train(known)
    assert names == ["de", "en"]
    rows = [(1, "the and of that", None, None, "h", "d"), (2, "", "de", None, None, None), (3, None, None, "de", None, None), (4, "das und der", "en", None, "h", "d"), (5, "", None, None, "g", "d")]
    items = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, suffix string, host string, domain string")
    got = {r["doc_id"]: r["lang"] for r in language.fuse(items, names, table).collect()}
    assert got[1] == "en" and got[2] == got[3] == got[4] == "de" and got[5] in names
    assert language.fuse(items.limit(0), names, table).count() == 0
    assert [r["lang"] for r in language.fuse(items, *language.train(known.limit(0))).collect()] == [None] * 5


def test_page_evidence(spark):
    page = spark.createDataFrame([("<!doctype html><html class=a LANG='fr-CA'><p>x</p><script>y</script>", "HTTP://u@A.Example.fr:80/de")], "html string, url string")
    got = page.select(language.markup_language(F.col("html")), language.host_of(F.col("url")), F.trim(language.plain_text(F.col("html")))).first()
    assert tuple(got) == ("fr", "a.example.fr", "x")


def test_rollups_count_every_batch_once(spark):
    kinds = "source string, lang string, version string, operation string, tokens bigint, old_tokens bigint"
    rollup = rollups.Rollup(spark, scratch_path(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    load = spark.createDataFrame([("a", "en", "1", "insert", 5, None), ("a", "en", "1", "insert", 7, None), (None, "en", "1", "insert", None, None)], kinds)
    assert rollup.commit("load", load) and not rollup.commit("load", load)
    rollup.commit("change", spark.createDataFrame([("a", "en", "1", "delete", 5, None), ("a", "en", "1", "revise", 9, 7)], kinds))
    want = [("None", "en", "1", 1, 0), ("a", "en", "1", 1, 9)]
    totals = lambda: sorted((str(r["source"]), r["lang"], r["version"], r["documents"], r["tokens"]) for r in rollup.totals().collect())
    assert totals() == want
    rollup.compact()
    assert totals() == want and not rollup.commit("load", load)
    rollup.commit("empty", load.limit(0))
    assert totals() == want
    with pytest.raises(Exception, match="unknown operation"):
        rollup.commit("bad", spark.createDataFrame([("a", "en", "1", "upsert", 5, None)], kinds))
