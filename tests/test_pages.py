"""Pages, domains, robots files and broken JSON against plain versions."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.operators import ingest, jsonfix, pages

SF = "/root/testdata/sf0.01"


def test_bytes_to_text():
    text = "Ünï — ok"
    assert pages.decoded(text.encode()) == text and pages.decoded(b"\xef\xbb\xbf" + text.encode()) == text
    assert pages.decoded(b"\xff\xfe" + text.encode("utf-16-le")) == text
    assert pages.decoded("Ünï".encode("latin-1"), "text/html; charset=ISO-8859-1") == "Ünï"
    assert pages.decoded(b'<meta charset="koi8-r">' + "да".encode("koi8-r")) == '<meta charset="koi8-r">да'
    assert pages.decoded(b"\x80 5", "text/html; charset=nonsense") == "\u20ac 5" and pages.decoded(b"") == ""


def test_blocks():
    html = "<html><title>A &amp; B</title><nav><p>menu</p></nav><p>one <b>tw</b>o <a href=x>three four</a></p>loose<br>text<div><style>p{}</style>deep<script>if (a<b) {}</script></div><ul><li>x<li>y</ul>"
    title, blocks = pages.read_blocks(html)
    assert title == "A & B"
    assert blocks == [("p", "one two three four", 4, 2), ("", "loose", 1, 0), ("", "text", 1, 0), ("div", "deep", 1, 0), ("li", "x", 1, 0), ("li", "y", 1, 0)]
    assert pages.read_blocks(None) == ("", []) and pages.read_blocks("<p>cut <a") == ("", [("p", "cut", 1, 0)])


def plain_content(blocks):
    """The tree, written out node by node."""
    out = []
    for i, (_, _, words, linked) in enumerate(blocks):
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        if linked / words > 1 / 3:
            out.append(False)
        elif before is None or before[3] / before[2] <= 5 / 9:
            if words > 16:
                out.append(True)
            elif (after[2] if after else 0) > 15:
                out.append(True)
            else:
                out.append((before[2] if before else 0) > 4)
        elif words > 40:
            out.append(True)
        else:
            out.append((after[2] if after else 0) > 17)
    return out


def test_main_text_equals_a_plain_version(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "<title>only</title>"), (-4, "<rss><title>A longer title</title><description>" + "d" * 50 + "</description></rss>"), (-5, "<p>" + "word " * 90 + "</p><p>" + "<a>link</a> " * 90)], "page_id long, html string")
    rows = table.select("page_id", "html").union(odd)
    got = {r.page_id: r for r in pages.main_texts(rows).collect()}
    ways = set()
    for r in rows.collect():
        title, blocks = pages.read_blocks(r.html)
        keep = plain_content(blocks)
        text = "\n\n".join(x for x in [title, *(b[1] for b, k in zip(blocks, keep, strict=True) if k)] if x)
        way = "density" if len(text.split()) > 60 else "feed" if r.html and ingest.is_feed(r.html) else "fallback"
        want = text if way == "density" else ingest.main_text(r.html)
        mine = got[r.page_id]
        assert (mine.main_text, mine.way, mine.words, mine.n_content) == (want, way, len(want.split()), sum(keep))
        ways.add(way)
    assert ways == {"density", "feed", "fallback"} and "link" not in got[-5].main_text
    # menus of the given pages are left out, their articles kept
    for r in table.limit(50).collect():
        menu = re.search(r"<nav>.*?</nav>", r.html, re.DOTALL)
        assert menu is None or not any(x and x in got[r.page_id].main_text.split("\n\n") for x in re.findall(r">([^<]+)</a>", menu[0]))


RULES = ["// a comment", "com", "uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "blog.com", " "]
#: The cases that public suffix lists are tested with.
HOSTS = {
    "example.com": "example.com", "b.example.com": "example.com", "com": None, "a.b.example.co.uk": "example.co.uk", "co.uk": None, "uk": None, "www.ck": "www.ck", "www.www.ck": "www.ck", "a.ck": None, "b.a.ck": "b.a.ck",
    "c.b.a.ck": "b.a.ck", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "blog.com": None, "me.blog.com": "me.blog.com", "a.me.blog.com": "me.blog.com",
    "x.unlisted": "x.unlisted", "a.x.unlisted": "x.unlisted", "unlisted": None, "10.1.2.3": "10.1.2.3", "UPPER.Com": "upper.com", "dot.com.": "dot.com",
}


def test_registered_domains(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    urls = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(HOSTS)] + [(-1, None), (-2, "no url")], "page_id long, url string")
    got = {r.page_id: r.domain for r in pages.registered_domains(urls, rules).collect()}
    assert [got[i] for i in range(len(HOSTS))] == list(HOSTS.values()) and got[-1] is None and got[-2] is None


ROBOTS = "User-agent: *\r\nDisallow: /p\r\nAllow: /p/ok # fine\nDisallow: /*.gif$\nDisallow: /a.b\n\nuser-agent: One\nUSER-AGENT: Two\nDisallow: /\nAllow: /x\nSitemap: s\nUser-agent: none\nDisallow:\n"


@pytest.mark.parametrize("agent,paths", [
    ("other", {"/": True, "/p": False, "/page": False, "/p/ok/1": True, "/i.gif": False, "/i.gif?x": True, "/a.b": False, "/axb": True, "": True}),
    ("one", {"/": False, "/x": True, "/p/ok": False, "": False}), ("TWO", {"/y": False, "/x/y": True}), ("none", {"/": True, "/p": True})])
def test_robots(spark, agent, paths):
    rules = pages.robots_rules(spark.createDataFrame([("h.example", ROBOTS), ("empty.example", None)], "host string, text string"))
    urls = spark.createDataFrame([(p, f"http://h.example{p}") for p in paths] + [("else", "http://empty.example/p"), ("unknown", "http://u.example/p"), ("null", None)], "p string, url string")
    got = {r.p: r.allowed for r in pages.robots_verdicts(urls, rules, agent).collect()}
    assert got == paths | {"else": True, "unknown": True, "null": True}


BROKEN = {
    '{"a": 1,}': {"a": 1}, "{'a': 'it''s'}": None, '{"a": [1, 2': {"a": [1, 2]}, '{"a": "cut': {"a": "cut"}, "{a: True, b: None}": {"a": True, "b": None}, '```json\n{"a": 1}\n```': {"a": 1}, '{"a" 1 "b" 2}': {"a": 1, "b": 2},
    '[1 2,,3]': [1, 2, 3], '{"a": {"b": [1, {"c": 2]}}': {"a": {"b": [1, {"c": 2}]}}, '{"a":}': {"a": None}, '{"a": 1 // note\n, "b": 2}': {"a": 1, "b": 2}, '{"a": New York, "b": 1.5}': {"a": "New York", "b": 1.5}, "{": {}, "]": None, "words": None, "": None,
    r'{"a": "x\\': {"a": "x\\"}, '{1: 2}': {"1": 2}, '{"a": NaN}': {"a": None}, '{"t": "q\\"uote", }': {"t": 'q"uote'},
}


def test_mended():
    for text, want in BROKEN.items():
        got = jsonfix.mended(text)
        if want is not None:
            assert json.loads(got) == want, text
        else:
            assert got is None or json.loads(got) is not None


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(st.characters(codec="utf-8"), max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=5), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=5), json_values, max_size=4), st.data())
def test_what_parses_is_itself_and_what_is_cut_still_parses(value, data):
    text = json.dumps(value, ensure_ascii=False)
    assert json.loads(jsonfix.mended(text)) == value
    cut = text[: data.draw(st.integers(1, len(text)))]
    got = json.loads(jsonfix.mended(cut))
    assert set(list(got)[:-1]) <= set(value)  # all but the last key are whole


def test_fixer_is_asked_up_to_five_times(spark):
    calls = []

    def fixer(text):
        calls.append(text)
        if len(calls) == 2:
            raise OSError
        return "still no" if len(calls) < 4 else '{"fixed": 1}'

    assert jsonfix.fixed("nothing", fixer) == ('{"fixed": 1}', "fixer") and len(calls) == 4
    never = []
    assert jsonfix.fixed("nothing", lambda t: never.append(t) or "no") == ("{}", "nothing") and len(never) == 5
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1'), (3, "nothing"), (4, None), (5, "[1]")], "i int, x string")
    got = {r.i: (r.repaired, r.way) for r in jsonfix.repaired(rows, "x", lambda t: '{"b": 2}').collect()}
    assert got == {1: ('{"a": 1}', "whole"), 2: ('{"a": 1}', "mended"), 3: ('{"b": 2}', "fixer"), 4: ("{}", "nothing"), 5: ("[1]", "whole")}
    plan = jsonfix.repaired(rows, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and rows.filter(F.col("x").isNull()).count() == 1
