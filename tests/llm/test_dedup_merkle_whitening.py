"""Bloom deduplication, the Merkle manifest and whitening against brute force."""

import hashlib
import math
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import bloomdedup, merkle, whitening

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, g string, kept int"


def documents(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, s, None if t is None else len(t), "a", "b", 1) for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "Text", None), (4, "tEXT", "b"), (5, "ÉCOLE x", "b"), (5, "école X", ""), (6, "ÉCOLE X", "b"), (7, "w " * 30_000, "c"), (None, "text", "c"), (8, "Text", "c"), (8, "Text", "c"), (None, None, None)]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- 12 ---


def plain_groups(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lowered(t or ""), []).append(i)
    out = []
    for i, t, _ in rows:
        ids = groups[lowered(t or "")]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lowered(t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [bloomdedup.BROADCAST_BYTES, 0])
def test_exact_groups_of_odd_rows(spark, limit):
    got = bloomdedup.exact_groups(documents(spark, ODD), broadcast_bytes=limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_groups(ODD)


@pytest.mark.parametrize("limit", [bloomdedup.BROADCAST_BYTES, 0])
def test_exact_groups_with_a_hot_text(spark, limit):
    """A third of all rows share one text, others pairs, triples and groups beyond one in a thousand."""
    rows = [(k, "hot" if k % 3 == 0 else "Mid" if k % 97 == 0 else f"pair {k // 2}" if k % 11 < 2 else f"text {k}", "s") for k in range(12_000)]
    got = bloomdedup.exact_groups(documents(spark, rows), broadcast_bytes=limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_groups(rows)


def test_few_rows_pass_the_filter(spark):
    rows = bloomdedup.digests(documents(spark, [(k, f"text {k}", "s") for k in range(20_000)]))
    blocks = bloomdedup.blocks_for(20_000)
    slots = bloomdedup.slot_counts(rows, blocks)
    maybe = bloomdedup.possibly_repeated(rows, slots, bloomdedup.bloom(slots), 20_000, blocks).filter("maybe").count()
    assert 0 < maybe < 20_000 * 0.03


def test_copies_are_dropped(spark):
    got = bloomdedup.drop_copies(documents(spark, ODD))
    assert got.columns == documents(spark, ODD).columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 5, 6, 7, 8]  # one 5 is a copy of 6, the other has a small é
    assert bloomdedup.exact_groups(documents(spark, []), "doc_id").count() == 0


def test_dedup_plan_has_no_python(spark):
    plan = bloomdedup.op12_bloom_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- 13 ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(i, text, lang, source, n_chars):
    return h(field(i), field(source), field(lang), field(n_chars), field(text))


def tree(nodes):
    """All levels of a list of nodes, down to one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][a : a + 16]) for a in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append((r, plain_leaf(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        trees[s] = tree([leaf for _, leaf in by_source[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for at, s in enumerate(sources):
        for i, (r, leaf) in enumerate(by_source[s]):
            p = path(trees[s], i) + path(top, at)
            now = leaf
            crc = zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode())
            if crc % 5 == 0:
                now = plain_leaf(r["doc_id"], None if r["text"] is None else lowered(r["text"]), r["lang"], s, r["n_chars"])
            for a, b in p:
                now = h(a, now, b)
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], h(*(x for q in p for x in q)), now, now == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check_manifest(docs):
    got = sorted((tuple(r) for r in merkle.manifest(docs).select(*COLUMNS).collect()), key=str)
    assert got == plain_manifest([r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    return got


def test_manifest_of_odd_rows(spark):
    check_manifest(documents(spark, ODD))
    check_manifest(documents(spark, [(1, "One", "a")]))
    check_manifest(documents(spark, [(k, "One", f"s{k}") for k in range(40)]))
    assert merkle.manifest(documents(spark, [])).count() == 0


def test_manifest_of_many_levels(spark):
    """One source of 5,001 rows needs four levels and two steps, beside small ones; several steps of sources as well."""
    rows = [(k, f"Text {k}", "hot" if k < 5001 else f"s{k % 300}") for k in range(6000)]
    got = check_manifest(documents(spark, rows))
    assert 0 < sum(not r[-1] for r in got) < 0.3 * len(got)
    # one level a step: the same rows by many more steps
    small = documents(spark, rows[4700:])
    got = sorted((tuple(r) for r in merkle.manifest(small.coalesce(3), levels=1).select(*COLUMNS).collect()), key=str)
    assert got == plain_manifest([r.asDict() for r in small.collect()])


# --- 11 ---


def plain_whitening(vectors, k=16):
    """(values, vectors, n, S) of the distinct whole vectors by a full eigendecomposition."""
    x = np.unique(np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000, axis=0)
    c = x - x.sum(0) / len(x)
    values, u = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1][:k], u[:, ::-1][:, :k], len(x), x.sum(0), values.sum()


def check_whitening(rows, got, k=16):
    values, u, n, s, trace = plain_whitening([v for _, v in rows], k)
    at = {}
    for r in got:
        at.setdefault(r.vec_id, {})[r.component] = r
    assert set(at) == {i for i, _ in rows}
    for i, v in rows:
        x = np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        for j, r in at[i].items():
            assert r.n == n and r.deviation == dev
            assert r.explained == pytest.approx(values[j - 1] / trace, rel=1e-9) and r.identity_error < 1e-9
            want = (x - s / n) @ u[:, j - 1] / math.sqrt(values[j - 1])
            assert abs(abs(r.whitened) - abs(want)) < 1e-6
    return at


def test_whitening_equals_the_full_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.op11_subspace_whitening(spark, SF).collect()
    at = check_whitening([(r.vec_id, r.embedding) for r in table.collect()], got)
    assert all(sorted(x) == list(range(1, 17)) for x in at.values())
    # one sign a component, over all rows: whitened columns are orthogonal and of unit variance
    z = np.array([[at[i][j].whitened for j in range(1, 17)] for i in sorted(at)])
    assert np.abs(z.T @ z / len(z) - np.eye(16)).max() < 1e-6


def test_a_steep_spectrum_needs_no_widening(spark):
    """Eigenvalues that fall by half: the first block of 6 columns certifies 3 components within a few passes; a flat one is widened."""
    rng = np.random.default_rng(3)
    steep = rng.standard_normal((400, 30)) * (40 * 0.5 ** np.arange(30))
    flat = rng.standard_normal((400, 30)) * 10
    for data, wide in ((steep, False), (flat, True)):
        rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
        fit = whitening.fitted(whitening.fit_list(whitening.rows_of(rows)).repartition(3), 3, 6)
        values, u, n, s, trace = plain_whitening(data, 3)
        assert np.allclose(fit.values, values, rtol=1e-10) and np.allclose(np.abs((fit.vectors * u).sum(0)), 1, atol=1e-9)
        assert fit.residuals.max() < 1e-12 and fit.passes <= 25 and (n, list(s)) == (fit.n, fit.sums)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (2, [1.0, 2.0, -3.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [1.0]), (9, [0.5, -0.5, 4.0]), (None, [0.0, 0.1, 0.9]), (10, [1e30, 0.0, 0.0])]
    t = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, x int, component double")
    good = [(i, v) for i, v in rows if i in (1, 2, 9, None) and v]
    got = whitening.whitened(t).collect()
    at = check_whitening([r for r in good], got, 3)
    assert len(at[1]) == 3 and len(got) == 3 * len(good)
    assert whitening.whitened(t.filter("vec_id = 2")).count() == 0 and whitening.whitened(t.limit(0)).count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(50)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


def test_library_without_the_optional_folder(tmp_path):
    """The rest imports without these operators."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(merkle.__file__)))).removesuffix("/sextant")
    code = "import sys; sys.modules['sextant.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]" % root
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0


def test_registered(spark):
    from sextant.llm import registry

    assert {"op11_subspace_whitening", "op12_bloom_dedup", "op13_merkle_superblocks"} <= set(registry.queries())
    assert spark.range(1).select(F.lit(1)).count() == 1
