"""Toxicity by weak supervision.

1. Executors count in how many toxic and clean training documents each feature (a word, or the first four to six letters of
   one) occurs; features that lean to toxic beyond chance make the lexicon. Here and in the class prior the labels end:
   nothing later sees them.
2. Voters: the lexicon's words, dealt into ``SLICES`` slices by evidence (a slice votes toxic for a text that holds one of its
   words, else clean), and patterns (shouting, runs of exclamation marks, masked and digit-for-letter spellings, drawn-out
   letters), which vote toxic or abstain.
3. A generative label model, a latent class with a forest of dependencies between voters, is estimated by expectation
   maximisation from the votes alone: each voter's rates in the two classes, so its accuracy, and its correlation with its
   parent in the forest.
4. A linear classifier over the whole lexicon and the patterns is trained on the model's posterior labels. Scores come from
   the classifier alone, so labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stored, table
from .langid import letter_runs

#: Labelled documents of each class that are fitted on, at most (in expectation; chosen by a hash of the id).
SAMPLE = 10_000
#: Lexicon size and evidence that a feature needs (log-likelihood ratio against the share of toxic documents).
LEXICON = 5_000
EVIDENCE = 7.0
#: Lexicon voters; how many voting words each toxic training text should have, and the share of toxic texts that a word must
#: still serve to be one (so that words of one text and its copies are none).
SLICES, COVER, SERVES = 16, 4, 0.004
#: Rounds of expectation maximisation; how many rows a voter's overall rate counts for in its rate given its parent; and
#: what a dependency must bring (times the logarithm of the rows, in nats) to be an edge.
ROUNDS, SMOOTH, EDGE = 60, 20.0, 1.0
PREFIXES = (4, 5, 6)
PATTERNS = ("shouting", "exclaiming", "masked", "digits", "drawn_out")
#: Words, and characters of words, that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS = 400_000, 8_000_000

_MASKED = re.compile(r"[^\W\d_][*#@$%]{1,6}[^\W\d_]")
_DIGITS = re.compile(r"[^\W\d_]+[0134578@$][^\W_]*[^\W\d_]")
_DRAWN = re.compile(r"([^\W\d_])\1{3}")
#: What those patterns need at least; most texts hold none of it, so the costlier search is spared.
_FOR_LETTERS, _MASKS = re.compile("[0134578@$]"), re.compile("[*#@$%]")
_BEYOND_ASCII = re.compile(r"[^\x00-\x7F]+")
_NO_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_NO_LETTERS = bytes(c for c in _NO_CAPITALS if not 97 <= c <= 122)
_AS_LETTER = str.maketrans("0134578@$", "oieastbas")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def spelled(text: str) -> list[str]:
    """The words of a text, lower-cased, and words with digits or signs for letters as they are meant."""
    found = letter_runs(text)
    if _FOR_LETTERS.search(text):
        found += [m.lower().translate(_AS_LETTER) for m in _DIGITS.findall(text)]
    return found


def letters_of(text: str) -> tuple[int, int]:
    """How many letters and capitals the whole text has; those of ASCII are counted as bytes."""
    plain = text.encode("ascii", "ignore")
    letters, capitals = len(plain.translate(None, _NO_LETTERS)), len(plain.translate(None, _NO_CAPITALS))
    if len(plain) < len(text):
        rest = "".join(_BEYOND_ASCII.findall(text))
        letters, capitals = letters + sum(map(str.isalpha, rest)), capitals + sum(map(str.isupper, rest))
    return letters, capitals


def patterns_of(text: str) -> list[bool]:
    letters, capitals = letters_of(text)
    shouting = letters > 5 and capitals > 0.5 * letters
    masked = _MASKS.search(text) is not None and _MASKED.search(text) is not None
    digits = _FOR_LETTERS.search(text) is not None and _DIGITS.search(text) is not None
    return [shouting, text.count("!!") > 3, masked, digits, _DRAWN.search(text) is not None]


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            seen[bool(toxic)].update({f for w in set(spelled(text or "")) for f in features_of(w)})
        names = [*seen[0], *(x for x in seen[1] if x not in seen[0])]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], ["feature", "clean", "toxic"])


class Finder(dict):
    """word -> number of its list of lexicon features (0: none); forgets all when it has met too many words or characters."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon, self.lists, self.chars = lexicon, [()], 0

    def __missing__(self, word: str) -> int:
        hits = tuple(i for f in features_of(word) if (i := self.lexicon.get(f)) is not None)
        if hits:
            self.lists.append(hits)
        self[word] = at = len(self.lists) - 1 if hits else 0
        self.chars += len(word)
        return at

    def found(self, text: str) -> set[int]:
        if len(self) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.clear()
            self.lists, self.chars = [()], 0
        return {i for at in set(map(self.__getitem__, spelled(text))) for i in self.lists[at]}


def dependencies(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none) in a maximum spanning tree of the mutual informations given the class, without weak edges.

    ``weight``: class x row.
    """
    k, v = votes.shape[1], votes.astype(float)
    info = np.zeros((k, k))
    for w in weight:
        total, one, p11 = w.sum(), w @ v, (v * w[:, None]).T @ v
        p10, p01 = one[:, None] - p11, one[None, :] - p11
        p00 = total - p11 - p10 - p01
        for joint, a, b in ((p11, one, one), (p10, one, total - one), (p01, total - one, one), (p00, total - one, total - one)):
            joint = np.maximum(joint, 0) + 0.25
            info += joint * np.log(joint * (total + 1) / ((a[:, None] + 0.5) * (b[None, :] + 0.5)))
    parent, best, inside = np.zeros(k, int), info[0].copy(), np.arange(k) == 0
    for _ in range(k - 1):  # Prim
        j = int(np.where(inside, -np.inf, best).argmax())
        inside[j] = True
        better = ~inside & (info[j] > best)
        parent[better], best[better] = j, info[j][better]
    parent[(best < EDGE * np.log(weight.sum() + 1)) | (np.arange(k) == 0)] = -1
    return parent


def label_model(votes: np.ndarray, prior: float, abstaining: np.ndarray | None = None, counts: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior probability of class 1 for each row of 0/1 votes, and the estimates; no label is seen.

    It begins with the rows of most votes, ``prior`` of all, as class 1. In each round voters form a forest
    (``dependencies``) and a voter's rate depends on the class and its parent's vote. A voter's 0 is a vote for class 0, or
    no evidence if the voter is ``abstaining``. ``counts``: how many rows each row stands for.
    """
    n, k = votes.shape
    counts = np.ones(n) if counts is None else counts
    abstaining = np.zeros(k, bool) if abstaining is None else abstaining
    v, fired = votes.astype(float), votes[:, ~abstaining].sum(1)
    order = np.argsort(-fired, kind="stable")
    edge = fired[order][min(n - 1, int(np.searchsorted(np.cumsum(counts[order]), prior * counts.sum())))]
    post = np.where(fired == 0, 0.02, np.where(fired >= edge, 0.9, 0.1))
    for _ in range(rounds):
        weight = np.stack([1 - post, post]) * counts
        total, one = weight.sum(1), weight @ v
        rate = (one + 0.5) / (total[:, None] + 1)
        parent = dependencies(votes, weight)
        given = np.repeat(rate[:, :, None], 2, axis=2)  # class x voter x parent's vote
        score = np.repeat(np.log([[1 - prior], [prior]]), n, axis=1)
        for j in range(k):
            up = parent[j]
            for c in range(2):
                if up >= 0:
                    both = (weight[c] * v[:, j]) @ v[:, up]
                    given[c, j, 1] = (both + SMOOTH * rate[c, j]) / (one[c, up] + SMOOTH)
                    given[c, j, 0] = (one[c, j] - both + SMOOTH * rate[c, j]) / (total[c] - one[c, up] + SMOOTH)
                p = given[c, j][votes[:, up]] if up >= 0 else given[c, j, 0]
                score[c] += np.where(votes[:, j] > 0, np.log(p), 0.0 if abstaining[j] else np.log1p(-p))
        last, post = post, 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(post - last).max() < 1e-6:
            break
    return post, {"parent": parent, "given": given, "rate": rate, "prior": prior, "abstaining": abstaining}


def linear(rows: list[list[int]], target: np.ndarray, width: int, rounds: int = 400, ridge: float = 0.3, counts: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression over 0/1 features by AdaGrad on all rows; the last weight is the constant. ``counts`` as above."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    w, g2 = np.zeros(width + 1), np.full(width + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(at, w[col], len(rows)) + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        miss = miss if counts is None else miss * counts
        grad = np.append(np.bincount(col, miss[at], width), miss.sum())
        grad[:-1] += ridge * w[:-1]
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
    return w


class Model:
    def __init__(self, lexicon: dict[str, int], weights: np.ndarray, estimates: dict):
        self.lexicon, self.weights, self.estimates = lexicon, weights, estimates


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic, weight) of labelled documents, at most about ``sample`` of each class. ``labels``: doc_id, toxic.

    ``weight`` is the inverse of the class's sampling rate, so weighted rows keep the labels' class shares at any size.
    """
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = stored(one.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("toxic")), "labels")
    have = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    limits = {c: max(1, int(1e6 * min(1, sample / max(1, have.get(c, 0))))) for c in (True, False)}
    limit = F.when(F.col("toxic"), limits[True]).otherwise(limits[False])
    few = one.filter(F.pmod(F.xxhash64(F.col("_id"), F.lit(3)), F.lit(1_000_000)) < limit).withColumn("weight", F.lit(1e6) / limit)
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # at most about 2 * sample rows of an id and a flag, so this side may be broadcast whatever the corpus
    return stored(own.join(F.broadcast(few), "_id").select("text", "toxic", "weight"), "toxicity-training")


def fit(rows: DataFrame) -> Model:
    """A model from training rows (text, toxic), with a weight that is one number in each class if classes are sampled."""
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    have = {r["toxic"]: (r["n"], r["w"]) for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.max(weight).alias("w")).collect()}
    n, all_n = sum(n for n, _ in have.values()), sum(n * w for n, w in have.values())
    # rows that each row stands for, by class; in all as many as there are, so that evidence and smoothing keep their size
    stand = {c: have[c][1] * n / all_n if c in have else 1.0 for c in (True, False)}
    base = min(max(have.get(True, (0, 0))[0] * stand[True] / max(n, 1), 1e-3), 0.999)
    seen = rows.mapInArrow(_occurrences, "feature string, clean long, toxic long").groupBy("feature").agg((stand[False] * F.sum("clean")).alias("clean"), (stand[True] * F.sum("toxic")).alias("toxic"), F.sum("toxic").alias("met"))
    all_, t, c = F.col("toxic") + F.col("clean"), F.col("toxic"), F.col("clean")
    evidence = F.when(t > 0, t * F.log(t / (all_ * base))).otherwise(0.0) + F.when(c > 0, c * F.log(c / (all_ * (1 - base)))).otherwise(0.0)
    lean = seen.filter((F.col("met") >= 2) & (t > all_ * base)).withColumn("evidence", F.round(evidence, 6)).filter(F.col("evidence") >= EVIDENCE)
    top = lean.orderBy(F.desc("evidence"), "feature").limit(LEXICON).select("feature", "toxic", "clean").collect()
    lexicon = {r["feature"]: i for i, r in enumerate(top)}
    # whole words that are found in toxic texts at least as often as in others may vote
    able = [lexicon[r["feature"]] for r in top if not r["feature"].endswith("-") and r["toxic"] >= r["clean"]]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            hits = [sorted(finder.found(x)) + [len(lexicon) + k for k, y in enumerate(patterns_of(x)) if y] for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column("toxic")], ["hits", "toxic"])

    got = rows.mapInArrow(read, "hits array<int>, toxic boolean").toArrow()  # bounded by the sample
    hits, gold = got.column("hits").to_pylist(), np.array(got.column("toxic").to_pylist(), bool)
    order = sorted(range(len(hits)), key=lambda i: (hits[i], gold[i]))  # sums don't depend on partitions
    hits = [hits[i] for i in order]
    counts = np.where(gold[order], stand[True], stand[False])
    width = len(lexicon) + len(PATTERNS)
    if not hits:
        return Model(lexicon, np.append(np.zeros(width), -2.0), {})
    matrix = votes_of(hits, len(lexicon), voting_words([h for h, i in zip(hits, order, strict=True) if gold[i]], able))
    post, estimates = label_model(matrix, base, np.arange(matrix.shape[1]) >= SLICES, counts)
    return Model(lexicon, linear(hits, post, width, counts=counts), estimates | {"votes": matrix, "posterior": post, "gold": gold[order]})


def voting_words(toxic: list[list[int]], able: list[int]) -> list[int]:
    """Of the ``able`` features, one after the other the one that most toxic rows with fewer than ``COVER`` chosen ones hold."""
    need, rows, gain = [COVER] * len(toxic), {f: [] for f in able}, dict.fromkeys(able, 0)
    for i, row in enumerate(toxic):
        for f in row:
            if f in gain:
                rows[f].append(i)
                gain[f] += 1
    out, least = [], max(2, SERVES * len(toxic))
    while gain:
        best = min(gain, key=lambda f: (-gain[f], f))
        if gain.pop(best) < least:
            break
        out.append(best)
        for i in rows[best]:
            need[i] -= 1
            if need[i] == 0:
                for f in toxic[i]:
                    if f in gain:
                        gain[f] -= 1
    return out


def votes_of(hits: list[list[int]], lexicon: int, voting: list[int]) -> np.ndarray:
    """Votes (rows x voters) from each row's lexicon features and patterns: ``SLICES`` slices of ``voting``, then the patterns."""
    slice_of = {f: k % SLICES for k, f in enumerate(voting)} | {lexicon + k: SLICES + k for k in range(len(PATTERNS))}
    out = np.zeros((len(hits), SLICES + len(PATTERNS)), np.int8)
    for i, row in enumerate(hits):
        out[i, [slice_of[f] for f in row if f in slice_of]] = 1
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row.

    Nulls and empty texts have no features and get the constant's score. Repeated rows are scored each; a score of just
    0.5 counts as toxic. An empty table gives no rows; texts of any length are read whole. Without training rows every text
    scores low. Only the id and the text are read, so other names cannot clash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = _scorer(docs.sparkSession, model)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def _scores(texts: list[str | None], finder: Finder, weights: np.ndarray) -> np.ndarray:
    n = len(finder.lexicon)
    z = [weights[sorted(finder.found(x))].sum() + weights[n:-1][patterns_of(x)].sum() if x else 0.0 for x in texts]
    return 1 / (1 + np.exp(-np.clip(np.array(z) + weights[-1], -500, 500)))


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast((model.lexicon, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        finder = Finder(lexicon)
        for batch in batches:
            s = _scores(batch.column("text").to_pylist(), finder, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = shared.value
        finder = Finder(lexicon)
        for batch in batches:
            keep = _scores(batch.column(at).to_pylist(), finder, weights) < 0.5
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """A model from the labels whose id's checksum modulo 5 is not 0."""
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    return fit(training_rows(docs, labels))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fitted(spark, docs, sf_dir))
    held: Column = remainder(F.col("doc_id"), 5) == 0
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op4_weak_supervision": op4_weak_supervision}
ORACLE: dict[str, str] = {}
