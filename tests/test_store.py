"""What is stored and gone on with: arrivals, graph tables, the graph source, positions and paces."""

import os
import shutil
import subprocess
import sys
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.operators import order, pace
from sextant.sources import graphstore, nodesource
from sextant.streaming import arrivals

OUT = "qid string, status string, n long"
COLUMNS = "qid string, n long"


def arrive(spark, at, ids, name):
    spark.createDataFrame([(q, i) for i, q in enumerate(ids)], COLUMNS).coalesce(1).write.parquet(f"{at}/in/{name}")


def run(spark, at, work, limit=None):
    query = arrivals.incremental(spark, f"{at}/in/*", COLUMNS, work, f"{at}/out", OUT, f"{at}/checkpoint", limit=limit, files_at_once=1)
    query.awaitTermination()


def told(rows):
    """Every third fails: a failure is a row too."""
    return rows.select("qid", F.when(F.substring("qid", 2, 9).cast("int") % 3 == 0, "fail").otherwise("ok").alias("status"), "n")


def stored(spark, at):
    return Counter(r.qid for r in arrivals.results(spark, f"{at}/out", OUT).collect())


def test_each_row_once_whatever_happens(spark, tmp_path):
    at = str(tmp_path)
    arrive(spark, at, ["q1", "q2", "q3", None, "", "q1"], "a")
    run(spark, at, told)
    assert stored(spark, at) == Counter(["q1", "q2", "q3"])
    arrive(spark, at, ["q3", "q4", "q5"], "b")
    arrive(spark, at, ["q5", "q6"], "c")

    def dies(rows):
        if rows.filter("qid = 'q6'").count():
            raise RuntimeError("lost")
        return told(rows)

    with pytest.raises(Exception, match="lost"):
        run(spark, at, dies)
    run(spark, at, told)
    assert stored(spark, at) == Counter([f"q{i}" for i in range(1, 7)])
    # killed after the part was written and before the batch was recorded: the batch is run again, into its own part
    last = max(int(p.name) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    for f in (tmp_path / "checkpoint" / "commits").glob(f"*{last}*"):
        f.unlink()
    run(spark, at, told)
    assert stored(spark, at) == Counter([f"q{i}" for i in range(1, 7)])
    # killed while it wrote: a part without its mark does not count, and is replaced
    (tmp_path / "out" / f"part_{last:05d}" / "_SUCCESS").unlink()
    assert sum(stored(spark, at).values()) < 6
    for f in (tmp_path / "checkpoint" / "commits").glob(f"*{last}*"):
        f.unlink()
    run(spark, at, told)
    assert stored(spark, at) == Counter([f"q{i}" for i in range(1, 7)])
    assert arrivals.results(spark, f"{at}/out", OUT).filter("status = 'fail'").count() == 2
    run(spark, at, dies)  # nothing new: no work


def test_limit_comes_before_what_is_done(spark, tmp_path):
    at = str(tmp_path)
    arrive(spark, at, ["q1", "q2", "q3"], "a")
    run(spark, at, told, limit=2)
    arrive(spark, at, ["q1", "q2", "q3"], "b")
    run(spark, at, told, limit=2)
    assert stored(spark, at) == Counter(["q1", "q2"])
    arrive(spark, at, ["q1", "q2", "q3"], "c")
    run(spark, at, told)
    assert stored(spark, at) == Counter(["q1", "q2", "q3"])


def test_positions(spark):
    rows = [(None if k % 7 == 0 else f"g{k % 3 if k % 2 else 0}", k * 37 % 1000, "x") for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, k long, _part string").repartition(6)
    got = order.positions(df, ["k"], ["g"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.position, r.k))
    for g, mine in by.items():
        assert sorted(mine) == list(enumerate(sorted(k for x, k, _ in rows if x == g)))
    assert [r.position for r in order.positions(df, ["k"]).orderBy("k").collect()] == list(range(1000))
    assert order.positions(df.limit(0), ["k"]).count() == 0


def test_a_late_row_waits_for_its_next_slot():
    """Calls that take long: every start lies in a slot of its own row, so starts of a domain never come closer than slots."""
    clock = [0.0]
    rows = [(f"u{s}", s, 6) for s in (0, 2, 4)]

    def call(url):
        clock[0] += 2.6
        return url

    def sleep(s):
        clock[0] += s

    got = list(pace.kept_pace(rows, call, 1.0, 0.25, lambda: clock[0], sleep))
    assert sorted(u for u, *_ in got) == ["u0", "u2", "u4"]
    for u, start, _ in got:
        slot = int(u[1:])
        assert (start - slot) % 6 <= 0.25


def test_pace_holds_across_tasks(spark):
    """A hot host and two small ones in four tasks: the delay is kept for each, and no task has all of the hot one."""
    urls = [f"http://hot.example/{i}" for i in range(24)] + [f"http://b{i % 2}.example/{i}" for i in range(6)] + ["nowhere"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")

    def fetch(url):
        if url.endswith("/5"):
            raise OSError("down")
        return url, "text/html", b"x"

    delay = 0.08
    began = time.time()
    got = pace.paced_fetch(rows, fetch, delay, 4).withColumn("task", F.spark_partition_id()).collect()
    assert Counter(r.url for r in got) == Counter(urls) and time.time() - began < 60
    for host in ("hot", "b0", "b1"):
        at = sorted(r.started for r in got if f"//{host}." in r.url)
        assert all(b - a >= delay * 0.95 for a, b in zip(at, at[1:], strict=False))
    hot = Counter(r.task for r in got if "//hot." in r.url)
    assert len(hot) == 4 and max(hot.values()) < 16
    assert {r.reason for r in got if r.url.endswith("/5")} == {"fetch_error:OSError"}


def test_shipped_package(spark, tmp_path):
    """Another folder, nothing installed: the zip that goes to the executors is all that a worker needs."""
    from sextant.session import ship

    ship(spark)
    zips = [f for f in spark.sparkContext.listFiles if f.endswith("sextant.zip")]
    assert zips
    path = zips[-1].removeprefix("file:")
    code = f"import sys; sys.path = [{path!r}] + [p for p in sys.path if 'repo' not in p]; import sextant.operators.pages as p; assert {path!r} in p.__file__"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0


def test_graph_store(spark):
    nodes = spark.createDataFrame([("City", "Paris", "a"), ("Person", "Paris", "b"), ("City", "Rome", "c"), ("City", "Rome", "b")] + [("City", f"c{i}", "x") for i in range(200)], "label string, id string, text string")
    store = graphstore.node_table(spark, nodes, partitions=16, buckets=2)
    new = spark.createDataFrame([("City", "Paris", "new", 3), ("River", "Paris", None, 5), ("City", "Rome", None, 7), (None, "Rome", "lost", 1)], "label string, id string, text string, size int")
    parts = store.touched(new.dropna(subset=["label", "id"]))
    assert 1 <= len(parts) <= 3
    merged = store.merged(new.dropna(subset=["label", "id"]).drop("size"), parts)
    # adaptive plans are printed in full only once they run
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    old_side = plan.split("SortMergeJoin")[1].split(":- ")[1].split("+- Sort")[0]
    assert "Exchange" not in old_side
    files = lambda: {f for f in spark.table(store.name).select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    before = files()
    assert store.upsert(new) == parts
    untouched = {f for f in before if not any(f"_part={p}/" in f for p in parts)}
    assert untouched and untouched <= files()
    got = {(r.label, r.id): (r.text, r["size"]) for r in store.rows().collect()}
    assert len(got) == 204 and got["City", "Paris"] == ("new", 3) and got["Person", "Paris"] == ("b", None) and got["River", "Paris"] == (None, 5) and got["City", "Rome"] == ("c", 7)
    store.upsert(spark.createDataFrame([("City", "Paris", "made", 9), ("Lake", "Como", "made", 9)], "label string, id string, text string, size int"), on_create=("text",))
    got = {(r.label, r.id): (r.text, r["size"]) for r in store.rows().collect()}
    assert got["City", "Paris"] == ("new", 9) and got["Lake", "Como"] == ("made", 9)
    with pytest.raises(ValueError):
        graphstore.node_table(spark, spark.createDataFrame([(None, "x")], "label string, id string"))
    store.drop()


def test_detach_delete_in_the_store(spark):
    nodes = graphstore.node_table(spark, spark.createDataFrame([("A", "1"), ("B", "1"), ("A", "2")], "label string, id string"), partitions=4, buckets=2)
    edges = graphstore.edge_table(spark, spark.createDataFrame([("A", "1", "R", "A", "2"), ("B", "1", "R", "A", "2"), ("A", "2", "R", "A", "1"), ("A", "2", "R", "B", "1")], "src_label string, src_id string, type string, dst_label string, dst_id string"), partitions=4, buckets=2)
    graphstore.detach_delete(nodes, edges, spark.createDataFrame([("A", "1"), ("Z", "9")], "label string, id string"))
    assert sorted(map(tuple, nodes.rows().collect())) == [("A", "2"), ("B", "1")]
    assert sorted(map(tuple, edges.rows().collect())) == [("A", "2", "R", "B", "1"), ("B", "1", "R", "A", "2")]
    graphstore.detach_delete(nodes, edges, nodes.rows())
    assert nodes.rows().count() == 0 and edges.rows().count() == 0
    nodes.drop()
    edges.drop()


def test_graph_source_takes_predicates(spark, tmp_path):
    path = f"file://{tmp_path}/nodes"
    rows = spark.range(2000).selectExpr("id", "CASE WHEN id < 1000 THEN 'City' ELSE 'Document' END AS label", "CASE WHEN id % 4 <> 0 THEN concat('text ', id) END AS text")
    rows.repartitionByRange(8, "id").write.parquet(path)
    df = nodesource.read_graph(spark, path).filter("label = 'Document' AND text IS NOT NULL AND length(text) > 3")
    assert sorted(r.id for r in df.collect()) == [i for i in range(1000, 2000) if i % 4]
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "length" in line]
    # what was pushed is not checked again: only the length is left to Spark
    assert len(filters) == 1 and "Document" not in filters[0] and "isnotnull" not in filters[0]
    reader = nodesource.GraphReader(path, df.schema, df.columns)
    assert len(reader.partitions()) >= 8
    from pyspark.sql.datasource import EqualTo, Not

    left = list(reader.pushFilters([EqualTo(("label",), "Document"), Not(EqualTo(("label",), "x"))]))
    assert len(left) == 1 and 4 <= len(reader.partitions()) <= 5  # row groups of other labels are not planned
    assert nodesource.read_graph(spark, path, ["id"]).columns == ["id"]
    shutil.rmtree(tmp_path / "nodes")
