"""Indexes against scans: vectors, many requests, names in texts, fuzzy words."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.operators import fulltext, gazetteer, index
from sextant.operators import retrieval as R

SF = "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def clustered(seed=5, rows=3000, width=24, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width))
    x = centres[rng.integers(groups, size=rows)] + 0.15 * rng.standard_normal((rows, width))
    return [(i, [float(v) for v in r / np.linalg.norm(r)]) for i, r in enumerate(x)]


def scan(vectors, request, k):
    one = vectors.sparkSession.createDataFrame([(0, [float(x) for x in request])], VECTORS)
    return [tuple(r) for r in R.top_k(R.scored(vectors, one), k).orderBy("rank").collect()]


def found(rows):
    return [tuple(r) for r in rows.orderBy("rank").collect()]


def test_index_search(spark):
    data = clustered()
    rows = spark.createDataFrame(data, VECTORS)
    made = index.build_index(rows, cells=32)
    assert made.vectors.count() == len(data)  # every row is in the index
    hits = 0
    for i in range(0, 3000, 150):
        q = data[i][1]
        best = scan(rows, q, 20)
        assert found(index.search_index(made, q, 20, probes=3, exact=True)) == best
        hits += len({r[0] for r in best} & {r[0] for r in found(index.search_index(made, q, 20, probes=6))})
    assert hits / (20 * 20) >= 0.9
    assert found(index.search_index(made, data[7][1], 20, probes=None)) == scan(rows, data[7][1], 20)


def test_probed_cells_are_pruned_from_the_scan(spark, vectors):
    made = index.build_index(vectors, cells=16)
    rows = index.search_index(made, vectors.filter("vec_id = 0").first()["embedding"], 5, probes=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan or "PartitionFilters: [isnotnull(cell" in plan or "cell#" in plan.split("PartitionFilters")[1][:80]


def test_recall_on_the_given_vectors(spark, vectors):
    """Probes calibrated on a sample reach the recall on other requests as well; the given vectors are nearly flat, so they are many."""
    made = index.build_index(vectors, cells=16)
    probes = index.calibrated_probes(made, 10, 0.95)
    asked = vectors.filter("vec_id % 100 = 7").collect()
    hits = sum(len({r[0] for r in scan(vectors, a["embedding"], 10)} & {r[0] for r in found(index.search_index(made, a["embedding"], 10, probes=probes))}) for a in asked)
    assert hits / (10 * len(asked)) >= 0.9 and probes < 16
    tight = index.build_index(spark.createDataFrame(clustered(), VECTORS), cells=32)
    assert index.calibrated_probes(tight, 10, 0.95) <= 8


def test_index_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (2, [0.0, 1.0]), (2, [0.0, 1.0])], VECTORS)
    assert found(index.search_index(index.build_index(rows, cells=2), [0.0, 1.0], 5)) == [(2, 1.0, 1), (2, 1.0, 2), (1, 0.0, 3)]
    assert index.search_index(index.build_index(rows.limit(0)), [0.0, 1.0], 5).count() == 0


def test_many_requests(spark):
    """Ties at the last place, several passes, fewer rows than places, missing vectors."""
    r = random.Random(4)
    data = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(3000)] + [(3000, None)]
    rows = spark.createDataFrame(data, VECTORS).repartition(5)
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("req_id"), "embedding")
    for k, at_once in ((7, 4096), (40, 20)):
        got = {}
        for x in index.batch_top_k(rows, asked, k, at_once=at_once).collect():
            got.setdefault(x.req_id, {})[x["rank"]] = (x.vec_id, x.score)
        vec = dict(data)
        assert set(got) == {i for i in range(0, 3000, 50)}
        for i, mine in got.items():
            want = sorted(((sum(a * b for a, b in zip(vec[i], v, strict=True)), j) for j, v in data if v), key=lambda x: (-x[0], x[1]))[:k]
            assert [mine[n] for n in range(1, k + 1)] == [(j, s) for s, j in want]
    assert index.batch_top_k(rows.limit(3), asked.limit(2), 10).count() == 6 and index.batch_top_k(rows, asked.limit(0), 10).count() == 0


def test_batch_plan_has_no_pairs(spark, vectors):
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("req_id"), "embedding")
    plan = index.batch_top_k(vectors, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_what_a_task_holds_of_many_requests_is_bounded(spark, monkeypatch):
    """The most scores that a task sorts at once, whatever the numbers of requests and vectors are; the rows stay those of a scan."""
    data = clustered(rows=1500, width=6)
    one = lambda n: index._one_pass(spark.createDataFrame([(i, v) for i, v in data], "vec_id long, v array<double>"), np.arange(n), np.array([v for _, v in data[:n]]), 5)
    runs = []
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda self, run, schema: runs.append(run))
    one(300)
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    monkeypatch.setattr(index, "SCORES", 4000)
    one(300)
    rows = pd.DataFrame({"vec_id": [i for i, _ in data], "v": [np.array(v) for _, v in data]})
    got = next(runs[1](iter([rows[:700], rows[700:]])))
    assert max(sizes) <= 300 * 5 + 2 * 4000 and len(got) == 300 * 5
    x = np.array([v for _, v in data])
    for req in (0, 17, 299):
        s = np.round(x @ x[req], 6)
        assert got[got.req_id == req].vec_id.tolist() == sorted(range(len(x)), key=lambda i: (-s[i], i))[:5]  # noqa: B023


NAMES = ["Saint Vincent and the Grenadines", "St. John", "saint", "City", "région Île-de-France", "a a", "", "...", "O'Neill & Sons", "the Grenadines"]


def test_mentions(spark):
    texts = [(1, "From Saint Vincent and the Grenadines to St John; ST.  JOHN's saint."), (2, None), (3, ""), (4, "A a a, région île DE france city"), (4, "st john"), (5, "o neill sons, Saint Vincent and the"), (None, "saint")]
    rows, names = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(n,) for n in NAMES], "name string")
    want = {(1, "Saint Vincent and the Grenadines", 1), (1, "the Grenadines", 1), (1, "St. John", 2), (1, "saint", 2), (4, "a a", 2), (4, "région Île-de-France", 1), (4, "St. John", 1), (5, "O'Neill & Sons", 1), (5, "saint", 1)}
    for limit in (gazetteer.BROADCAST_BYTES, 0):
        assert {tuple(r) for r in gazetteer.mentions(rows, names, limit=limit).collect()} == want


def test_mentions_by_trie_and_by_join_agree(spark):
    r = random.Random(9)
    word = lambda: r.choice(["the", "of", "a", *"bcdefghij"])
    rows = spark.createDataFrame([(i, " ".join(word() for _ in range(r.randint(0, 200)))) for i in range(80)], "doc_id long, text string")
    names = spark.createDataFrame([(" ".join(word() for _ in range(r.randint(1, 6))),) for _ in range(300)], "name string")
    one, other = (sorted(map(tuple, gazetteer.mentions(rows, names, limit=limit).collect())) for limit in (1 << 30, 0))
    assert one == other and len(one) > 500


def test_names_that_no_text_holds_cost_nothing(spark):
    """Of far more names than a trie may have, those whose tokens all occur in texts are few; else only anchors leave their texts."""
    rows = spark.createDataFrame([(i, "We saw the old bridge of Somewhere " + "and more " * 300) for i in range(30)], "doc_id long, text string")
    names = spark.range(3000).select(F.concat(F.lit("old O"), "id").alias("name")).union(spark.createDataFrame([("old bridge of somewhere",), ("the old",)], "name string"))
    got = gazetteer.mentions(rows, names, limit=20_000)
    assert "BatchEvalPython" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 60
    assert sorted(map(tuple, gazetteer.mentions(rows, names, limit=0).collect())) == sorted(map(tuple, got.collect()))
    known = gazetteer.possible(rows, gazetteer.known_names(names))
    assert {r.location for r in known.collect()} == {"old bridge of somewhere", "the old"}
    for limit in (0, 1 << 20):
        out = gazetteer.joined(rows.withColumnRenamed("doc_id", "id"), known, limit)
        assert out.count() == 60


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_index_equals_the_comparison_of_all(spark):
    """Words around the length at which the index changes its keys, each with up to three edits."""
    r = random.Random(2)
    letters = "abcé"

    def changed(w):
        for _ in range(r.randint(0, 3)):
            i = r.randint(0, len(w))
            w = r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])
        return w

    words = ["".join(r.choice(letters) for _ in range(n)) for n in (1, 2, 3, 5, 8, 17, 18, 19, 20, 21, 22, 23, 24, 30, 64) for _ in range(2)]
    texts = [(i, " ".join(changed(r.choice(words)) for _ in range(12))) for i in range(120)] + [(500, None), (501, "")]
    made = fulltext.build(spark.createDataFrame(texts, "id long, text string"), "id", ["text"])
    tokens = {t for _, x in texts if x for t in x.split()}
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    for limit in (2, 1, 0):
        want = {(w, t, edits(w, t)) for w in words for t in tokens if edits(w, t) <= limit}
        assert {tuple(x) for x in fulltext.matches(made, asked, limit).collect()} == want


def test_postings_and_search(spark):
    made = fulltext.build(spark.createDataFrame([(1, "Big Ben, big tower", "x"), (2, "bog", None), (3, "ben tower", "bag")], "id long, text string, more string"), "id", ["text", "more"])
    assert {(r.token, r.node_id, r.n, tuple(r.positions)) for r in made.postings.filter("node_id = 1").collect()} == {("big", 1, 2, (0, 2)), ("ben", 1, 1, (1,)), ("tower", 1, 1, (3,)), ("x", 1, 1, (4,))}
    ask = lambda *w: {tuple(r) for r in fulltext.search(made, spark.createDataFrame([(x,) for x in w], "word string"), 1).collect()}
    assert ask("BIG") == {(1, 2, 0), (2, 1, 1), (3, 1, 1)}
    assert ask("big", "towr") == {(1, 3, 1), (3, 2, 2)}
    plan = fulltext.matches(made, spark.createDataFrame([("big",)], "word string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and plan.count("Join Inner") == 1, plan


def test_postings_of_repeated_nodes_and_few_keys_a_token(spark):
    """Rows of one node are one text; a token of any length has at most 29 keys, and postings are not moved once they are made."""
    texts = [(1, "b a b"), (1, "a c"), (2, None), (None, "a"), (3, " ".join(f"w{i}" for i in range(500)) + " abcdefghijklmnopqrst w7")]
    made = fulltext.build(spark.createDataFrame(texts, "id long, text string"), "id", ["text"])
    got = {(r.token, r.node_id, r.n, tuple(r.positions)) for r in made.postings.collect()}
    assert got >= {("a", 1, 2, (0, 1)), ("b", 1, 2, (0, 2)), ("c", 1, 1, (1,)), ("a", None, 1, (0,)), ("w7", 3, 2, (7, 501)), ("w499", 3, 1, (499,))} and len(got) == 505
    keys = made.neighbours.groupBy("token").count().agg(F.max("count")).first()[0]
    assert keys <= 29
