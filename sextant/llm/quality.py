"""Quality rules: fixed limits on word counts and repetition, then robust multivariate outliers (DataFrame functions only).

Every (language, source) group, every language and the whole table get a minimum-covariance-determinant estimate of location
and scatter of five transformed statistics: from several starts (medians with MADs, the plain mean and covariance, medians
alone) concentration steps take the closest ``CORE`` share, its mean and covariance, and again; the start that ends with the
smallest determinant counts. A group's estimate is then blended with its language's, and that with the table's, which count as
``PRIOR`` documents each: small groups lean on what is above them, large ones hardly, and no size switches anything. A document
is rejected when its squared Mahalanobis distance to its group's estimate, scaled so that the median distance is the
chi-square median, is over ``CUTOFF``.

Order statistics come from counts in fine bins, found by coarse bins first, so a group of any size (a third of all rows in one
source) only adds counters: no group is ever gathered in a task. The table of estimates has a few rows per group; up to
``SMALL`` bytes, counted, it is broadcast and the documents stay where they are, beyond that both are dealt by group and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, discard, stored, table, words

MIN_WORDS = 50
#: Statistics on a grid of 1/1024, so that sums hardly depend on the order of addition.
GRID = 1024
STATS = ["ln_words", "ln_word_length", "symbols", "repeated_words", "repeated_lines"]
#: Standard deviations added to each statistic, of the size of one measurement, because most groups hardly vary in the last three:
#: a tenth of the words, a fiftieth of the word length, a symbol in 2,500 characters, 7 % of the words or 13 % of the lines that
#: are there once repeated. The rest is the group's own spread. Each is so small that the statistic alone passes CUTOFF within its
#: range at the least scale of a group without spread of its own, 1 (repeated words from a share of 0.43 on, lines from 0.65).
FLOOR = [0.1, 0.02, 0.02, 0.07, 0.13]
CORE = 0.75
STEPS = 3
#: Documents that the estimate above counts for in a group's or a language's.
PRIOR = 200
#: Median and 1 - 7e-13 quantile of chi-square with five degrees of freedom; so far out because the tails of clean text are heavy.
CHI2_MEDIAN = 4.351
CUTOFF = 66.0
#: Bins of ln(1 + squared distance), 64 to the unit.
BINS = 64
#: Grid values, or bins, to a coarse bin.
COARSE = 64
ALL = "[]"
#: Bytes of estimates that are broadcast at most (some 20,000 groups of short names), and the salts of a group beyond that.
SMALL = 8 << 20
SALTS = 32


def with_statistics(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the contract's counts. Needs free names: it adds n_words ... n_repeat_words and drops its helpers."""
    out = docs.withColumns({"_words": words(text), "_lines": F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    # the words of a window hash one after the other, each seeded by the one before, so borders between them count
    window = lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2])
    out = out.withColumn("_windows", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<long>")))
    pairs = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    out = out.withColumn("_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs).otherwise(F.array().cast("array<struct<h:long,p:int>>")))
    beside = lambda x, i: F.coalesce(F.get("_pairs", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_pairs", i + 1)["h"] == x["h"], F.lit(False))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_pairs", beside), lambda x: x["p"])))
    covered = F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3))))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(F.coalesce(text, F.lit(""))) - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[#*$%&|<>]+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop("_words", "_lines", "_windows", "_pairs", "_at")


def transformed() -> dict[str, Column]:
    """The statistics vector on the grid: logarithms of sizes, the square root of a rare share, and logarithms of how many
    times what is there once."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    times = lambda a, b: F.log((F.col(b) + 1) / (F.col(b) - F.col(a) + 1))
    raw = [
        F.log1p(F.col("n_words")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        times("n_repeat_words", "n_words"),
        times("n_dup_lines", "n_lines"),
    ]
    return {s: F.round(x * GRID) / GRID for s, x in zip(STATS, raw, strict=True)}


def _own() -> Column:
    return F.to_json(F.array("lang", "source"))


def _language() -> Column:
    return F.to_json(F.array("lang"))


def _at_share(counts: DataFrame, keys: list[str], value: str, share: float, name: str, step: float) -> DataFrame:
    """The smallest ``value`` of each key at which the running count reaches ``share`` of the key's rows.

    ``counts`` has a row per key and distinct value (column ``_n``). Coarse bins of ``step`` are counted first, then the values
    of the one bin that holds the answer, so no task reads more than a few hundred counts of a key.
    """
    over = W.partitionBy(*keys)
    coarse = F.floor(F.col(value) / F.lit(step))
    bins = counts.groupBy(*keys, coarse.alias("_b")).agg(F.sum("_n").alias("_n"))
    ran = bins.withColumns({"_run": F.sum("_n").over(over.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(over)})
    need = F.ceil(F.lit(share) * F.col("_all"))
    at = ran.filter(F.col("_run") >= need).groupBy(*keys).agg(F.min(F.struct("_b", (need - F.col("_run") + F.col("_n")).alias("_need"))).alias("_at"))
    fine = counts.withColumn("_b", coarse).join(at.select(*keys, F.col("_at._b").alias("_b"), "_at._need"), [*keys, "_b"])
    ran = fine.withColumn("_run", F.sum("_n").over(over.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    return ran.filter(F.col("_run") >= F.col("_need")).groupBy(*keys).agg(F.min(value).alias(name))


_P = range(len(STATS))
_MEANS = [f"_m{i}" for i in _P]
_SCATTER = [f"_c{i}_{j}" for i in _P for j in range(i + 1)]


_SUMS = [f"_s{i}" for i in _P] + [f"_q{i}_{j}" for i in _P for j in range(i + 1)]


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products of each key's rows."""
    sums = [*STATS, *[f"{STATS[i]} * {STATS[j]}" for i in _P for j in range(i + 1)]]
    return rows.groupBy(*keys).agg(F.expr("count(1) AS _n"), *[F.expr(f"sum({x}) AS {n}") for n, x in zip(_SUMS, sums, strict=True)])


def _moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and covariance from ``_summed`` columns, one row a key."""
    mean = [f"round(_s{i} / _n, 9) AS _m{i}" for i in _P]
    floor = lambda i, j: f" + {FLOOR[i] ** 2!r}D" if i == j else ""
    return sums.selectExpr(*keys, *mean, *[f"round(_q{i}_{j} / _n - (_s{i} / _n) * (_s{j} / _n){floor(i, j)}, 9) AS _c{i}_{j}" for i in _P for j in range(i + 1)])


def _starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(_key, _start, location, scatter): 0 medians and 1.4826 * MADs, 1 mean and covariance, 2 medians and the same spread for all."""
    middle = _at_share(counts, ["_key", "_k"], "_v", 0.5, "_m", COARSE / GRID)
    off = counts.join(middle, ["_key", "_k"]).withColumn("_d", F.abs(F.col("_v") - F.col("_m"))).groupBy("_key", "_k", "_m", "_d").agg(F.sum("_n").alias("_n"))
    spread = _at_share(off, ["_key", "_k", "_m"], "_d", 0.5, "_s", COARSE / GRID)
    wide = spread.groupBy("_key").agg(*[F.expr(x) for k in _P for x in (f"max(CASE WHEN _k = {k} THEN _m END) AS _m{k}", f"pow(greatest(1.4826D * max(CASE WHEN _k = {k} THEN _s END), {FLOOR[k]}D), 2) AS _v{k}")])
    scatter = lambda of: [f"{of(i) if i == j else '0D'} AS _c{i}_{j}" for i in _P for j in range(i + 1)]
    first = wide.selectExpr("_key", "0 AS _start", *_MEANS, *scatter(lambda i: f"_v{i}"))
    second = _moments(_summed(rows, ["_key"]), ["_key"]).select("_key", F.lit(1).alias("_start"), *_MEANS, *_SCATTER)
    third = wide.selectExpr("_key", "2 AS _start", *_MEANS, *scatter(lambda i: "1D"))
    return first.union(second).union(third)


def _factored(params: DataFrame) -> DataFrame:
    """Adds the inverse of the Cholesky factor of each group's scatter as columns ``_w{i}_{j}``, and ``_size``, half the
    logarithm of the determinant."""
    out = params
    for j in _P:
        rest = [" - ".join([f"_c{i}_{j}", *[f"_l{i}_{k} * _l{j}_{k}" for k in range(j)]]) for i in _P]
        out = out.selectExpr("*", f"sqrt(greatest({rest[j]}, 1e-6D)) AS _l{j}_{j}")
        if j < _P[-1]:
            out = out.selectExpr("*", *[f"({rest[i]}) / _l{j}_{j} AS _l{i}_{j}" for i in _P[j + 1 :]])
    for i in _P:
        row = ["-(" + " + ".join(f"_l{i}_{k} * _w{k}_{j}" for k in range(j, i)) + f") / _l{i}_{i} AS _w{i}_{j}" for j in range(i)]
        out = out.selectExpr("*", *row, f"1 / _l{i}_{i} AS _w{i}_{i}")
    size = " + ".join(f"ln(_l{i}_{i})" for i in _P)
    return out.selectExpr(*params.columns, *[f"_w{i}_{j}" for i in _P for j in range(i + 1)], f"round({size}, 9) AS _size")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds ``_d2``, the squared length of the deviation in units of the group's factor."""
    z = ["(" + " + ".join(f"_w{i}_{j} * ({STATS[j]} - _m{j})" for j in range(i + 1)) + ")" for i in _P]
    return rows.selectExpr("*", " + ".join(f"{x} * {x}" for x in z) + " AS _d2")


def _beside(rows: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the estimates of their ``_key``, whatever the number of groups and the share of rows in one."""
    size = F.sum(F.octet_length("_key") + 8 * len(params.columns))
    if params.agg(F.coalesce(size, F.lit(0))).first()[0] <= SMALL:
        return rows.join(F.broadcast(params), "_key", how)
    dealt = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, ["_key", "_salt"], how).drop("_salt")


def _binned(rows: DataFrame, params: DataFrame) -> DataFrame:
    keep = ["_key", "_start", *STATS]
    return _distance(_beside(rows, params)).select(*keep, F.floor(F.log1p("_d2") * BINS).cast("int").alias("_bin"))


def _concentrated(rows: DataFrame, params: DataFrame, used: list[DataFrame]) -> DataFrame:
    """One concentration step: mean and covariance of each key's ``CORE`` share with the smallest distances, for each start.

    Rows are read once: their sums by bin of distance tell both where the core ends and what it sums to.
    """
    keys = ["_key", "_start"]
    bins = stored(_summed(_binned(rows, params), [*keys, "_bin"]), "quality-bins")
    used.append(bins)
    edge = _at_share(bins, keys, "_bin", CORE, "_edge", COARSE)
    core = bins.join(edge, keys).filter(F.col("_bin") <= F.col("_edge")).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["_n", *_SUMS]])
    return _moments(core, keys)


def _blended(own: DataFrame, above: DataFrame) -> DataFrame:
    """``own`` (_above, _n, location, scatter, _scale) as if ``PRIOR`` documents with the estimate ``above`` it were among its rows."""
    cols = [*_MEANS, *_SCATTER, "_scale"]
    both = own.join(above.selectExpr("_key AS _above", *[f"{c} AS _a{c}" for c in cols]), "_above").selectExpr("*", f"_n / (_n + {PRIOR}) AS _w")
    mix = lambda c: f"_w * {c} + (1 - _w) * _a{c}"
    scatter = [f"{mix(f'_c{i}_{j}')} + _w * (1 - _w) * (_m{i} - _a_m{i}) * (_m{j} - _a_m{j}) AS _c{i}_{j}" for i in _P for j in range(i + 1)]
    return both.selectExpr("_key", *[f"{mix(c)} AS {c}" for c in _MEANS], *scatter, "exp(_w * ln(_scale) + (1 - _w) * ln(_a_scale)) AS _scale")


def fitted(stats: DataFrame) -> DataFrame:
    """(_key, location, inverse factor, ``_scale``) for every (lang, source) of ``stats``.

    ``stats`` needs lang, source and the five statistics of the documents that pass the fixed limits. The result is as small as
    the number of groups; it is stored.
    """
    rows = stats.select(F.explode(F.array(_own(), _language(), F.lit(ALL))).alias("_key"), *STATS)
    long = stats.select("lang", "source", F.posexplode(F.array(*STATS)).alias("_k", "_v")).groupBy("lang", "source", "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    long = long.select(F.explode(F.array(_own(), _language(), F.lit(ALL))).alias("_key"), "_k", "_v", "_n")
    counts = stored(long.groupBy("_key", "_k", "_v").agg(F.sum("_n").alias("_n")), "quality-counts")
    used = [counts, params := stored(_factored(_starts(rows, counts)), "quality-start")]
    for _ in range(STEPS):
        used.append(params := stored(_factored(_concentrated(rows, params, used)), "quality-step"))
    names = [c for c in params.columns if c not in ("_key", "_size")]
    best = params.groupBy("_key").agg(F.min(F.struct("_size", *names)).alias("_best")).select("_key", *[f"_best.{c}" for c in names])
    used.append(best := stored(best, "quality-best"))
    bins = _binned(rows, best).groupBy("_key", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    used.append(bins := stored(bins, "quality-bins"))
    scale = F.lit(CHI2_MEDIAN) / F.greatest(F.expm1((F.col("_middle") + 1) / F.lit(float(BINS))), F.lit(CHI2_MEDIAN / 4))
    middle = _at_share(bins, ["_key"], "_bin", 0.5, "_middle", COARSE).join(bins.groupBy("_key").agg(F.sum("_n").alias("_n")), "_key")
    raw = stored(best.join(middle, "_key").select("_key", "_n", *_MEANS, *_SCATTER, scale.alias("_scale")), "quality-raw")
    used.append(raw)
    above = stats.select(_own().alias("_key"), _language().alias("_above")).distinct()
    languages = above.select(F.col("_above").alias("_key"), F.lit(ALL).alias("_above")).distinct()
    languages = _blended(raw.join(languages, "_key"), raw.filter(F.col("_key") == ALL))
    out = stored(_factored(_blended(raw.join(above, "_key"), languages)), "quality-fitted")
    discard(*used)
    return out


def verdicts(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """``rows`` (lang, source, statistics, base_failed) with ``kept``; without any row that passes the limits there is no estimate, and nothing is kept anyway."""
    out = _distance(_beside(rows.withColumn("_key", _own()), fit, "left"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d2") * F.col("_scale") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept`` and the scaled squared distance.

    Nulls: a null text has no words and fails; null languages and sources form groups of their own. A group of one document
    is judged by its language's estimate, nearly. Repeated rows are judged each. Equal distances share a bin, so ties are in
    the core together; of equal determinants the first start counts. An empty table gives no rows. Other columns are not
    read, so their names cannot clash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"))
    stats = stored(with_statistics(own, F.col("_text")).drop("_text").withColumns(transformed()), "quality-stats")
    out = verdicts(stats, fitted(stats.filter(~F.col("base_failed"))))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", (F.col("_d2") * F.col("_scale")).alias("distance"))


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were (texts are read twice rather than shuffled)."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = with_statistics(own, F.col(f"_row.{text_col}")).withColumns(transformed())
    # a generator of one row: the optimiser copies no expression through it, so statistics are computed once a text
    rows = rows.select("_row", "lang", "source", F.inline(F.array(F.struct(*STATS, "base_failed"))))
    slim = stored(rows.filter(~F.col("base_failed")).select("lang", "source", *STATS), "quality-stats")
    return verdicts(rows, fitted(slim)).filter("kept").select("_row.*")


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("distance")


QUERIES = {"op2_quality_mcd": op2_quality_mcd}
ORACLE: dict[str, str] = {}
