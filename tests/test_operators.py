"""Order, null and tie semantics on hand-made rows."""

from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import graph as G
from sextant.operators import fetch, ingest, jsonfix, language, questions, records
from sextant.operators import retrieval as R
from sextant.plans.graph import Graph
from sextant.sources import io
from sextant.streaming import windows

NODE = "node_id string, labels array<string>, id string, qidLabel string, qid string, text string"
EDGE = "edge_id string, src string, dst string, type string, rel_type string, rel_type_en string, rel_group string"


def make(spark, nodes, edges):
    rows = [(n, labels, n, None, qid, None) for n, labels, qid in nodes]
    links = [(f"e{i}", a, b, "REL", "r", None, g) for i, (a, b, g) in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, NODE), spark.createDataFrame(links, EDGE))


def test_text_edges(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "a\r\nb\rc "), (3, " x  y\t z\n\n\n\nq "), (4, "Cookie policy applies\nok text"), (5, "one two three four")], "i int, t string")
    got = {r.i: r for r in rows.select("i", T.newlines(F.col("t")).alias("n"), T.clean(F.col("t")).alias("c"), T.word_count(F.col("t")).alias("w")).collect()}
    assert got[0].n is None and got[0].w == 0 and got[1].c == ""
    assert got[2].n == "a\nb\nc"
    assert got[3].c == "x y z\n\nq"
    assert got[4].c == "ok text"
    assert got[5].w == 4


def test_predicates_and_ids(spark):
    rows = spark.createDataFrame([(" 'located-in' ", "wd:Q1"), ("__A__B__", "http://x/Q2"), ("né à", " Q3 "), ("!!!", ""), (None, None)], "p string, q string")
    got = rows.select(T.predicate(F.col("p")).alias("p"), T.entity_id(F.col("q")).alias("q")).collect()
    assert [r.p for r in got] == ["LOCATED_IN", "A_B", "NÉ_À", "", None]
    assert [r.q for r in got] == ["Q1", "Q2", "Q3", None, None]


@pytest.mark.parametrize("n,chunks", [(0, 0), (1, 1), (750, 1), (751, 2), (1450, 2), (1451, 3)])
def test_chunk_lengths(spark, n, chunks):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
    got = [r.chunk.split() for r in T.chunks(docs, 750, 50).orderBy("chunk_index").collect()]
    assert len(got) == chunks
    joined = got[0] + [w for c in got[1:] for w in c[50:]] if got else []
    assert joined == [f"w{i}" for i in range(n)]


def test_degrees_and_paths(spark):
    g = make(spark, [("a", ["City"], "a"), ("b", ["City"], "b"), ("c", ["Country"], "c"), ("d", ["Region"], "d"), ("x", ["City"], None)],
             [("a", "a", None), ("a", "b", "LOCATED_IN"), ("b", "c", "LOCATED_IN"), ("c", "d", "LOCATED_IN"), ("a", "b", "LOCATED_IN"), ("x", "a", "OTHER")])
    deg = {r.node_id: (r.in_degree, r.out_degree) for r in G.degrees(g).collect()}
    assert deg == {"a": (2, 3), "b": (2, 1), "c": (1, 1), "d": (1, 0), "x": (0, 1)}
    target = spark.createDataFrame([("d",)], "node_id string")
    assert {r.node_id for r in G.reaches_all(g, target).collect()} == {"a", "b", "c"}
    target = spark.createDataFrame([("b",)], "node_id string")
    assert {r.node_id for r in G.reaches_any(g, target).collect()} == {"a", "x"}
    starts = g.nodes.select("node_id")
    assert {r.node_id for r in G.reach_from(g, starts, target, 2, every=False).collect()} == {"a", "x"}
    some = starts.filter("node_id IN ('a', 'd')")
    assert {r.node_id: (r.in_degree, r.out_degree) for r in G.degrees_of(g, some).collect()} == {"a": (2, 3), "d": (1, 0)}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef"), st.sampled_from(["LOCATED_IN", None])), min_size=1, max_size=14))
def test_paths_against_search(spark, edges):
    g = make(spark, [(n, ["City"], n) for n in "abcdef"], edges)
    want = set()
    for start in "abcdef":
        queue = deque([(start, 0)])
        while queue:
            at, k = queue.popleft()
            for a, b, kind in edges:
                if a == at and kind and k < 3:
                    if b == "f":
                        want.add(start)
                    queue.append((b, k + 1))
    target = spark.createDataFrame([("f",)], "node_id string")
    assert {r.node_id for r in G.reaches_all(g, target).collect()} == want
    assert {r.node_id for r in G.reach_from(g, g.nodes.select("node_id"), target, 3, every=True).collect()} == want


def test_facts_keep_anchors_without_any(spark):
    g = make(spark, [("a", ["__Entity__"], "qa"), ("b", ["__Entity__"], "qb"), ("c", ["__Entity__"], "qc")], [("a", "b", None), ("b", "a", "ABOUT"), ("a", "a", "OTHER")])
    heads = spark.createDataFrame([("qa", "a", "A"), ("qc", "c", None)], "qid string, node_id string, label string")
    got = {r.qid: r for r in G.facts(g, heads, 1).collect()}
    assert got["qa"].n_facts == 1 and got["qa"].facts == "A --[r]-- b"
    assert got["qc"].n_facts == 0 and got["qc"].facts == ""


def test_writes(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", None)], "k string, v string, w string")
    new = spark.createDataFrame([("2", "B"), ("2", "B"), ("3", "C")], "k string, v string")
    assert sorted(map(tuple, G.upsert(old, new, ["k"]).collect())) == [("1", "a", "x"), ("2", "B", None), ("3", "C", None)]
    assert sorted(map(tuple, G.update(old, new, ["k"]).collect())) == [("1", "a", "x"), ("2", "B", None)]
    more = spark.createDataFrame([("2", "B", 7)], "k string, v string, fresh int")
    assert sorted(map(tuple, G.upsert(old, more, ["k"]).collect())) == [("1", "a", "x", None), ("2", "B", None, 7)]
    assert sorted(map(tuple, G.update(old, more, ["k"]).collect())) == [("1", "a", "x", None), ("2", "B", None, 7)]
    again = G.upsert(G.upsert(old, new, ["k"]), new, ["k"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, G.upsert(old, new, ["k"]).collect()))


def test_regroup_first_wins_and_null_overwrites(spark):
    edges = spark.createDataFrame([("1", "a", "b", "REL", "x", None, "OLD"), ("2", "a", "b", "REL", "y", None, "OLD"), ("3", "a", "b", "MENTIONS", "x", None, "OLD"), ("4", "a", "b", "REL", "z", None, "OLD")], EDGE)
    m = spark.createDataFrame([(0, "x", "NEW", 0.5), (1, "x", "LATE", 0.6), (2, "y", None, None)], "ordinal int, rel_type string, rel_group string, rel_score double")
    assert {r.edge_id: r.rel_group for r in G.regrouped(edges, m).collect()} == {"1": "NEW", "2": None, "3": "OLD", "4": "OLD"}
    m = m.withColumns({"rel_type_en": F.lit("EN"), "rel_type_norm": F.lit("en")})
    assert {r.edge_id: (r.rel_type_en, r.rel_type_norm) for r in G.regrouped(edges, m).collect()} == {"1": ("EN", "en"), "2": ("EN", "en"), "3": (None, None), "4": (None, None)}


def test_fusion_and_topk(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "vec_id long, score double")
    b = spark.createDataFrame([(2, 1.0), (3, 0.2)], "vec_id long, score double")
    assert {r.vec_id: r.score for r in R.fused(a, b).collect()} == {1: 0.5, 2: 0.7, 3: 0.2}
    assert [(r.vec_id, r["rank"]) for r in R.top_k(a, 10).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_rerank_ties(spark):
    g = make(spark, [("d1", ["Document"], "q1"), ("d2", ["Document"], "q2")], [("d1", "d1", None)])
    docs = spark.createDataFrame([(1, "q1", "L1", "t", 0.5), (2, "q1", "L1b", "t", 0.5), (3, "q2", "L2", "t", 0.5), (4, None, "n", "t", 0.9), (5, "q9", "gone", "in AFRICA", 0.5)], "rank int, qid string, qidLabel string, text string, score double")
    names = spark.createDataFrame([("africa",)], "name string")
    got = [(r.qid, r.label) for r in R.reranked(g, docs, names, 10).orderBy("rank").collect()]
    assert got == [("q9", "gone"), ("q1", "L1"), ("q2", "L2")]


def test_ingest(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "doc_id long, text string")
    done = spark.createDataFrame([(1,)], "doc_id long")
    assert {r.doc_id for r in ingest.pending(docs, done, "doc_id").collect()} == {2, None}
    have = spark.createDataFrame([(1,)], "vec_id long")
    got = {r.doc_id: len(r.embedding) for r in ingest.backfilled(docs, have).collect()}
    assert got == {2: 0, None: 16}
    urls = spark.createDataFrame([("http://a/x",), ("http://a/no",), ("http://b/bad",)], "url string")

    def fetch(url):
        if "bad" in url:
            raise OSError("down")
        return url, "text/html", b"<p>"

    rows = {r.url: r.reason for r in ingest.harvest(urls, fetch, lambda u: not u.endswith("no")).collect()}
    assert rows == {"http://a/x": None, "http://a/no": "robots_disallow", "http://b/bad": "fetch_error:OSError"}


def test_main_text():
    html = "<title>T</title><nav>skip</nav><h1>Heading one</h1><h2>abc</h2><p>" + "word " * 10 + "</p><p>short</p><script>x</script>"
    assert ingest.main_text(html) == "T\n\nHeading one\n\n" + " ".join(["word"] * 10)
    assert ingest.main_text(None) == ""


def test_records(spark):
    bad = spark.createDataFrame([(1, '{"k": 2}'), (2, '{"k": 3,}'), (3, ""), (4, None)], "event_id long, props string")
    assert {r.event_id: r.repaired for r in jsonfix.repaired(bad, "props").collect()} == {1: '{"k": 2}', 2: '{"k": 3}', 3: "{}", 4: "{}"}
    lists = spark.createDataFrame([(1, ["a", "b", "c"], [1, 2]), (2, [], [1]), (3, None, [1]), (4, ["a"], [7, 8])], "i int, x array<string>, y array<int>")
    got = {r.i: [tuple(z) for z in r.z] for r in lists.select("i", records.zipped(F.col("x"), F.col("y")).alias("z")).collect() if r.z is not None}
    assert {k: v for k, v in got.items() if v} == {1: [("a", 1), ("b", 2)], 4: [("a", 7)]}
    docs = spark.createDataFrame([(1, "Big: big.\nbig Ben, ben ; people, People; people"), (2, None), (3, "x*y x y, z")], "doc_id long, text string")
    assert sorted(map(tuple, records.kept_keywords(docs).collect())) == [(1, "ben"), (3, "x"), (3, "z")]


def test_token_windows_of_a_tokenizer(spark):
    """Windows over characters as tokens, checked against slices; and a tokenizer of a library round-trips."""
    text = "".join(chr(97 + i % 26) for i in range(103))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ab")], "doc_id long, text string")
    encode, decode = lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids))
    got = T.token_chunks(docs, encode, decode, 10, 3).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in got if r.doc_id == 1]
    assert [r.chunk for r in mine] == [text[a : a + 10] for a in range(0, 100, 7)] and [r.chunk for r in got if r.doc_id == 4] == ["ab"]
    assert "".join([mine[0].chunk, *(r.chunk[3:] for r in mine[1:])]) == text and all(r.tokens == len(r.chunk) for r in got)
    with pytest.raises(ValueError):
        T.token_chunks(docs, encode, decode, 3, 3)
    one = T.chunks(docs, 5, 1, metadata=["doc_id", "text"]).filter("doc_id = 4").first()
    assert one.metadata.doc_id == "4" and one.metadata.text == "ab"


def test_language_by_learned_words(spark):
    docs = spark.createDataFrame([("der Hund und die Katze und der Vogel", "de"), ("the dog and the cat and the bird", "en"), ("le chien et le chat", None), (None, "de")], "text string, lang string")
    model = language.learned(docs, per_language=5)
    assert set(model) == {"de", "en"} and model["de"] == (8, {"der": 2, "und": 2, "die": 1, "hund": 1, "katze": 1})
    rows = spark.createDataFrame([(1, "Die Katze"), (2, "THE bird"), (3, "123 !"), (4, None), (5, "zzz")], "i int, text string")
    assert {r.i: r.detected for r in language.detected(rows, model).collect()} == {1: "de", 2: "en", 3: None, 4: None, 5: "de"}
    assert language.detected(rows, {}).filter("detected IS NOT NULL").count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.detected(docs.filter("doc_id % 2 = 1 AND lang IS NOT NULL"), language.learned(docs.filter("doc_id % 2 = 0")))
    assert got.filter("detected = lang").count() > 0.95 * got.count()


def test_pending_by_two_columns_and_attached_nodes(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "q string, t string")
    done = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "x")], "q string, t string")
    assert sorted(map(tuple, ingest.pending(rows, done, ["q", "t"]).collect()), key=str) == [("a", "y"), ("b", "x"), (None, "x")]
    links = G.attached(spark.createDataFrame([("d1", "q", "s"), ("d2", "q", "s")], "node_id string, qid string, source_tag string"), spark.createDataFrame([("q", "s", "X", None, 1.5, -2.0)], "qid string, source_tag string, country string, location string, lat double, lon double"))
    assert links.count() == 4 and sorted(map(tuple, G.attached_nodes(links).collect()), key=str) == [("Coordinates", "1.5,-2.0", 1.5, -2.0), ("Country", "X", None, None)]


def test_paths_of_two_edges_use_two(spark):
    """A self-loop at a target is no second edge of itself, a parallel one is."""
    loop = make(spark, [("t", ["City"], "t"), ("x", ["City"], "x")], [("t", "t", "OTHER"), ("x", "t", "OTHER")])
    target = spark.createDataFrame([("t",)], "node_id string")
    assert G.reaches_any(loop, target).count() == 0
    both = make(spark, [("t", ["City"], "t"), ("x", ["City"], "x")], [("t", "t", "LOCATED_IN"), ("t", "t", "OTHER"), ("x", "t", "OTHER")])
    assert {r.node_id for r in G.reaches_any(both, target).collect()} == {"t", "x"} == {r.node_id for r in G.reach_from(both, both.nodes.select("node_id"), target, 2, every=False).collect()}


def test_io_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", 'x "q"\ny'), ("c", ""), ("d", "  \t blanks "), ("e", "\r\n\\,"), ("f", "null")], "k string, v string")
    for kind in ("parquet", "csv", "json"):
        path = str(tmp_path / kind)
        io.write(rows, path, kind)
        assert sorted(io.read(spark, path, kind, rows.schema).collect(), key=lambda r: r.k) == rows.collect(), kind
    assert io.state(spark, str(tmp_path / "missing"), "k string").isEmpty()
    with pytest.raises(ValueError):
        io.detect("a.xyz")


def test_stream_counts_like_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:0{i % 7}:00", i % 3, "t", 1.0) for i in range(40)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "5 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling_out").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("tumbling_out").collect()))
    assert got == sorted(map(tuple, windows.tumbling(rows, "5 minutes").collect()))


def test_entity_calls_wait_and_go_on():
    waits, answers = [], iter([(429, {}), (200, {"error": {"code": "maxlag"}}), (200, {"entities": {"Q1": {}}})])
    assert fetch.fetch_entities(["Q1"], lambda ids: next(answers), waits.append) == {"Q1": {}}
    assert waits == [1.5, 4.0]
    with pytest.raises(OSError):
        fetch.fetch_entities(["Q1"], lambda ids: (503, {}), waits.append)
    with pytest.raises(OSError):
        fetch.fetch_entities(["Q1"], lambda ids: (404, {}), lambda s: pytest.fail("no wait"))


def test_retries():
    calls, waits = [], []

    def overloaded(*args):
        calls.append(args)
        if len(calls) < 4:
            raise OSError("429 Too Many Requests")
        return "done"

    assert fetch.retried_on_overload(overloaded, sleep=waits.append)("x") == "done"
    assert [int(w) for w in waits] == [1, 2, 4] and calls == [("x",)] * 4
    with pytest.raises(ValueError):
        fetch.retried_on_overload(lambda: int("x"), sleep=lambda s: pytest.fail("no wait"))()
    tries = []
    with pytest.raises(ValueError):
        ingest.retried(lambda: tries.append(1) or int("x"), 3, lambda n: 0)()
    assert len(tries) == 3
    made = []
    make = lambda: made.append(1) or object()
    assert fetch.resource(make) is fetch.resource(make) and made == [1]


def test_crawl_reasons(spark):
    def get(url):
        if "down" in url:
            raise OSError("down")
        return url + "/", "x", b"%PDF" if "doc" in url else b"plain text" if "plain" in url else b"<html><title>The title of it</title><p>" + b"the word of and " * 6 + b"</p>"

    rows = spark.createDataFrame([("a", "A", "http://x/down"), ("b", "B", "http://x/doc"), ("c", "C", "http://x/plain"), ("d", "D", "http://y/ok"), ("e", "E", "http://y/no"), ("f", "F", None), ("g", "G", "http://y/done")], "qid string, qidLabel string, website string")
    done = spark.createDataFrame([("g",), (None,)], "qid string")
    got = {r.qid: r for r in fetch.crawl_resumable(rows, done, get, allowed=lambda u: "no" not in u, pdf=lambda b: "five words are in it").collect()}
    assert {q: r.reason for q, r in got.items()} == {"a": "fetch_error:down", "b": None, "c": "too_short_or_empty", "d": None, "e": "robots_disallow"}
    assert got["b"].text == "five words are in it" and got["d"].lang == "en" and got["d"].final_url == "http://y/ok/"
    first = fetch.crawl_resumable(rows, done, get, 2).collect()
    assert {r.qid for r in first} == {"a", "b"} and {r.qid for r in fetch.first_rows(rows, 0, "qid").collect()} == set("abcdefg")


def test_stored_crawl_by_row(spark):
    """Rows of one url, each with what was stored for it; a row of that url for which nothing was stored failed."""
    rows = spark.createDataFrame([(q, q, "http://x/1") for q in "abc"], "qid string, qidLabel string, website string")
    page = lambda words: bytearray(f"<p>{'a word of it ' * words}</p>".encode())
    stored = spark.createDataFrame([("a", "http://x/1", "http://x/a", page(9)), ("b", "http://x/1", "http://x/b", page(1))], "qid string, url string, final_url string, content binary")
    got = {r.qid: (r.reason, r.final_url) for r in fetch.crawl(rows, stored).collect()}
    assert got == {"a": (None, "http://x/a"), "b": ("too_short_or_empty", None), "c": ("fetch_error:not stored", None)}


def test_robots_and_sniffing(spark):
    loads = []

    def load(url):
        loads.append(url)
        if "broken" in url:
            raise OSError
        return "User-agent: *\nDisallow: /private"

    ok = fetch.robots_allow(load, "crawler")
    assert ok("http://a/x") and not ok("http://a/private/1") and ok("http://broken/private") and len(loads) == 2
    kinds = spark.createDataFrame([(0, bytearray(b"%PDF-1"), "u"), (1, bytearray(b"x"), "http://a/X.PDF"), (2, bytearray(b" <p>"), "u"), (3, bytearray(b"none"), "u"), (4, bytearray(b"\xff\xfe<"), "u")], "i int, c binary, u string")
    assert [r.k for r in kinds.orderBy("i").select(fetch.kind_of(F.col("c"), F.col("u")).alias("k")).collect()] == ["pdf", "pdf", "html", None, "html"]
    assert fetch.guessed_language("der Hund und die Katze") == "de" and fetch.guessed_language("xyz") is None


def test_feeds_and_dropped_tags():
    feed = "<?xml version='1.0'?><rss><title>A long title</title><title>A long title</title><item><description>" + "many words " * 6 + "</description></item></rss>"
    assert ingest.main_text(feed) == "A long title\n\n" + " ".join(["many words"] * 6)
    html = "<svg><p>" + "drawn " * 10 + "</p></svg><aside><p>" + "aside " * 10 + "</p></aside>"
    assert ingest.main_text(html) == " ".join(["aside"] * 10)


def test_pages_behind_transports(spark):
    rows = spark.createDataFrame([("http://e/wiki/Big_Ben",), ("http://e/wiki/x",), (None,)], "website string")
    got = [r.text for r in fetch.summaries(rows, lambda t: (200, f"about {t}") if t != "x" else (404, "no")).collect()]
    assert got == ["about Big_Ben", None, None]
    got = [(r.text, r.reason) for r in fetch.summaries(rows, lambda t: 1 / 0).collect()]
    assert set(got) <= {(None, "error:ZeroDivisionError"), (None, None)} and (None, "error:ZeroDivisionError") in got
    stored = spark.createDataFrame([("Big_Ben", 200, "stored")], "title string, status int, extract string")
    assert "stored" in [r.text for r in fetch.summaries(rows, stored).collect()]
    long = "<p>" + "word " * 3000 + "</p>"
    got = [r.text for r in fetch.external(rows, lambda u: (200, long) if "Ben" in u else (500, "x")).collect()]
    assert len(got[0]) == 5000 and got[1:] == [None, None]


def test_batches_by_position(spark):
    rows = spark.createDataFrame([(i * i * 7,) for i in range(900)], "k long")
    got = sorted((r.k, r._batch) for r in fetch.numbered(rows, "k", 100).collect())
    assert [b for _, b in got] == [i // 100 for i in range(900)]


def test_graph_documents_and_extraction(spark):
    def extract(text):
        if "bad" in text:
            raise ValueError
        return fetch.capitalised(text)

    docs = spark.createDataFrame([(1, "Big Ben rings in Old Town"), (2, "Big Ben rings in Old Town"), (3, " "), (4, "bad one")], "doc_id long, text string")
    out = fetch.extracted(docs, extract, tries=1).cache()
    assert {r.doc_id: r.error for r in out.collect()} == {1: None, 2: None, 4: "ValueError"}
    nodes, edges = G.graph_documents(out.filter("error IS NULL"))
    assert {(r.id, r.label) for r in nodes.collect() if r.label == "Name"} == {("Big Ben", "Name"), ("Old Town", "Name")}
    assert nodes.filter("label = 'Document'").count() == 1 and edges.count() == 3


def test_equal_ids_of_two_labels_stay_two(spark):
    docs = spark.createDataFrame(
        [("t1", [("Paris", "City"), ("Paris", "Person")], [("Paris", "Seine", "AT")], {"id": "src 1"}), ("t2", [("Paris", "City"), ("Seine", "River")], [("Paris", "Seine", "AT")], {})],
        "text string, nodes array<struct<id:string,type:string>>, relationships array<struct<source:string,target:string,type:string>>, metadata map<string,string>")
    nodes, edges = G.graph_documents(docs)
    assert {tuple(r) for r in nodes.collect() if r.label != "Document"} == {("Paris", "City"), ("Paris", "Person"), ("Seine", "River"), ("Seine", "Node")}
    got = {tuple(r) for r in edges.collect()}
    assert {e for e in got if e[4] == "AT"} == {("Paris", "City", "Seine", "Node", "AT"), ("Paris", "Person", "Seine", "Node", "AT"), ("Paris", "City", "Seine", "River", "AT")}
    assert {e[2:4] for e in got if e[:2] == ("src 1", "Document")} == {("Paris", "City"), ("Paris", "Person")}


def test_graph_documents_look_up_labels_only_where_they_differ(spark):
    """Documents whose names have one label and whose ends are all known, against the same with a name of another label beside
    them; and one pass over what the extractor made."""
    names = [f"N{i}" for i in range(60)]
    rels = [(a, b, "NEXT") for a, b in zip(names, names[1:], strict=False)]
    schema = "text string, nodes array<struct<id:string,type:string>>, relationships array<struct<source:string,target:string,type:string>>"
    of = lambda nodes, r=rels: spark.createDataFrame([("t", nodes, r)], schema)
    own = [(n, "Name") for n in names]
    nodes, edges = G.graph_documents(of(own))
    also_nodes, also_edges = G.graph_documents(of([*own, ("other", "Thing")]))
    got = {tuple(r) for r in edges.collect()}
    assert got == {tuple(r) for r in also_edges.filter("dst <> 'other'").collect()} and len(got) == 119
    assert {tuple(r) for r in also_nodes.collect()} - {tuple(r) for r in nodes.collect()} == {("other", "Thing")}
    unknown = {tuple(r)[:4] for r in G.graph_documents(of(own[:1], [("N0", "N9", "NEXT"), ("N0", None, "NEXT")]))[1].filter("type = 'NEXT'").collect()}
    assert unknown == {("N0", "Name", "N9", "Node"), ("N0", "Name", None, "Node")}
    assert G.graph_documents(spark.createDataFrame([("t", None, None)], schema))[1].count() == 0
    plan = G.graph_documents(fetch.extracted(spark.createDataFrame([("A Bb Cc",)], "text string"), fetch.capitalised))[1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython [") == 1 and "Arrow" not in plan and "MapInPandas" not in plan, plan


def test_next_batches_go_on_from_the_last(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 5, 6, 1000, 2000, 7000)], "k long")
    done = spark.createDataFrame([(0, 0), (1000, 0), (2000, 1)], "k long, b long")
    for more in ({}, {"batch_col": "b"}):
        assert sorted(map(tuple, ingest.next_batches(rows, done, "k", 2, **more).collect())) == [(1, 2), (5, 2), (6, 3), (7000, 3)]
    assert sorted(map(tuple, ingest.next_batches(rows, done.limit(0), "k", 4).collect()))[:5] == [(0, 0), (1, 0), (5, 0), (6, 0), (1000, 1)]


def test_upsert_on_create_and_ties(spark):
    old = spark.createDataFrame([("1", "a", "x")], "k string, v string, w string")
    new = spark.createDataFrame([("1", "b", "n"), ("2", "c", "n"), ("2", "b", "z")], "k string, v string, w string")
    assert sorted(map(tuple, G.upsert(old, new, ["k"], ("w",)).collect())) == [("1", "b", "x"), ("2", "c", "n")]


def test_importance_needs_targets(spark):
    g = make(spark, [("d1", ["Document"], "q1"), ("d2", ["Document"], "q2")], [("d1", "d2", None)])
    docs = spark.createDataFrame([(1, "q1", "L1", "t", 0.5)], "rank int, qid string, qidLabel string, text string, score double")
    score = lambda names: R.reranked(g, docs, spark.createDataFrame(names, "name string"), 5).first().score
    assert score([]) == 0.5 and score([("nowhere",)]) > 0.5


def test_questions(spark):
    one = spark.range(1)
    ask = lambda c, k, q="q": one.select(questions.retrieval_string(F.lit(c).cast("string"), F.lit(k).cast("array<string>") if k is None else F.array(*map(F.lit, k)), F.lit(q)).alias("x")).first().x
    assert ask("a tower, old", ["b", "a,c", "b"]) == "a tower  old a c b" and ask(None, ["b"]) == "q" and ask("x", None) == "q"
    assert one.select(questions.cleaned_caption(F.lit(" a personal view of people ")).alias("x")).first().x == "a al view of"
    assert one.select(questions.prompt("{a} and {b}", a=F.lit("x"), b=F.lit(None)).alias("x")).first().x == "x and "
    assert T.without_surrogates("a\ud800b") == "ab" and T.without_surrogates(None) is None
    assert ingest.complete(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "b").collect() == [(2, "x")]


def test_more_sources_and_sinks(spark, tmp_path):
    folder = str(tmp_path / "parts")
    rows = spark.range(5)
    assert [io.append_part(rows, folder) for _ in range(2)] == [f"{folder}/part_00000", f"{folder}/part_00001"]
    state = str(tmp_path / "state")
    io.replace_state(rows, state)
    io.replace_state(io.state(spark, state, "id long").filter("id > 2"), state)
    assert io.state(spark, state, "id long").count() == 2
    # a version whose writer was cut off, then one whose file is damaged: readers see the one before
    (tmp_path / "state" / "v2").mkdir()
    assert io.state(spark, state, "id long").count() == 2
    (tmp_path / "state" / "v2" / "_SUCCESS").touch()
    (tmp_path / "state" / "v2" / "part-0.parquet").write_bytes(b"no Parquet")
    assert io.state(spark, state, "id long").count() == 2
    io.replace_state(rows.filter("id = 0"), state)
    assert [r.id for r in io.state(spark, state, "id long").collect()] == [0]
    for tag in ("b", "a"):
        for n in (1, 0):
            io.append_batch(spark.createDataFrame([(tag, n)], "t string, n int"), str(tmp_path / "docs" / tag), n)
    got = io.graph_batches_of(spark, [str(tmp_path / "docs" / x) for x in ("b", "missing", "a")]).collect()
    assert sorted((r.t, r.n) for r in got) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    with pytest.raises(FileNotFoundError):
        io.graph_batches_of(spark, [str(tmp_path / "missing")])
    with pytest.raises(FileNotFoundError):
        io.images(spark, str(tmp_path / "missing.png"))
    (tmp_path / "x.png").write_bytes(b"png")
    assert io.images(spark, str(tmp_path / "x.png")).first().length == 3
    (tmp_path / "ids.csv").write_text("p1\np2\np3\n")
    assert sorted(tuple(r) for r in io.lines(spark, str(tmp_path / "ids.csv"), "photo_id").collect()) == [(0, "p1"), (1, "p2"), (2, "p3")]
    rows.write.parquet(str(tmp_path / "vectors"))
    assert io.vectors(spark, str(tmp_path / "nope"), str(tmp_path / "vectors")).count() == 5 and io.request(spark, "a").first().text_input == ""


def test_lines_of_split_files(spark, tmp_path):
    """Blank lines count, files follow each other by path, and a file in many splits keeps its order."""
    want = [f"line {i} " + "x" * (i % 90) if i % 17 else "" for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(want[:2000]) + "\n")
    (tmp_path / "b.txt").write_text("\r\n".join(want[2000:]))
    (tmp_path / "c.txt").write_text("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(kept, ("5000", "0"), strict=True):
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert [r.value for r in sorted(io.lines(spark, str(tmp_path)).collect())] == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_deduplicated_stream_rows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:00:00")], "user_id long, ts string")
    assert windows.deduplicated(rows, ["user_id"]).count() == 2


def test_evidence_rounds_scores_as_printf_does(spark):
    scores = [0.03125, 0.15625, 0.12345, 1.00005, 0.98765, 0.20005, 2.0, 1234.5]
    cand = spark.createDataFrame([(f"C{i}", None, x, i) for i, x in enumerate(scores)], "qid string, label string, score double, rank int")
    docs = spark.createDataFrame([("C0", "a\nb", 1)], "qid string, text string, rank int")
    got = {r.rank: r.block for r in R.evidence(docs, cand).collect()}
    assert got == {i: f"== None (Score={x:.4f}) ==\n" + ("a b..." if not i else "No text available....") for i, x in enumerate(scores)}


def test_pages_are_read_some_at_a_time(spark):
    """No step that reads whole pages takes Arrow batches, which hold 10,000 of them."""
    from sextant.operators import pages

    rows = spark.createDataFrame([(1, "<title>A title</title><p>" + "word " * 90 + "</p>"), (2, None)], "page_id long, html string")
    stored = rows.select(F.lit("u").alias("url"), F.lit("u").alias("final_url"), F.encode("html", "UTF-8").alias("content"))
    asked = spark.createDataFrame([("q", "q", "u")], "qid string, qidLabel string, website string")
    for out in (ingest.main_texts(rows), pages.main_texts(rows), fetch.crawl(asked, stored)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEval" not in plan and "MapInPandas" not in plan
        assert out.count() == 2
