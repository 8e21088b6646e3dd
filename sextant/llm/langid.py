"""Language identification, word first: known words score by their log frequency in each language, unseen ones by the
longest character n-grams that are known (four letters, then three, two, one).

The model is counted on a bounded sample of labelled documents, by the executors; what reaches the driver is the list of
frequent words and n-grams of that sample. Scoring streams Arrow batches; each worker keeps the vectors of the words it met
in a table that is bounded in words and in characters.
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

#: Labelled documents that the model is counted on, at most (in expectation; chosen by a hash of the id).
SAMPLE = 8_000
#: A word is known from this count on.
MIN_COUNT = 3
SIZES = (4, 3, 2, 1)
#: No word favours one language over another by more than this many nats.
CLIP = 6.0
#: Rows of a worker's table of word vectors, and characters of their words.
CAPACITY, CAPACITY_CHARS = 1 << 19, 8_000_000

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(letter_runs(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])


class Model:
    """Log-frequency vectors of words and n-grams, relative to each one's best language."""

    def __init__(self, langs: list[str], words: dict[str, dict[str, int]], grams: dict[str, dict[str, int]]):
        self.langs = langs
        self.words = self._vectors(words)
        self.grams: dict[str, np.ndarray] = {}
        for k in SIZES:
            self.grams |= self._vectors({g: c for g, c in grams.items() if len(g) == k})

    def _vectors(self, counts: dict[str, dict[str, int]]) -> dict[str, np.ndarray]:
        """An add-a-half estimate in each language, as float32 rows."""
        if not counts:
            return {}
        keys = sorted(counts)
        n = np.array([[counts[k].get(x, 0) for x in self.langs] for k in keys], float)
        logs = np.log(n + 0.5) - np.log(n.sum(0) + 0.5 * len(keys))
        logs = np.maximum(logs - logs.max(1, keepdims=True), -CLIP).astype(np.float32)
        return dict(zip(keys, logs, strict=True))

    def vector(self, word: str) -> np.ndarray:
        if (v := self.words.get(word)) is not None:
            return v
        padded = f"<{word}>"
        for k in SIZES:
            known = [v for i in range(len(padded) - k + 1) if (v := self.grams.get(padded[i : i + k])) is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs), np.float32)


class _Table(dict):
    """word -> row of its vector; rows of words met are kept until the table holds too many words or characters, then it starts anew.

    It can pass the bound on characters by those of one text.
    """

    def __init__(self, model: Model, capacity: int = CAPACITY, chars: int = CAPACITY_CHARS):
        super().__init__()
        self.model, self.rows = model, np.zeros((capacity, len(model.langs)), np.float32)
        self.chars, self.most_chars = 0, chars

    def __missing__(self, word: str) -> int:
        at = len(self)
        self.rows[at] = self.model.vector(word)
        self[word] = at
        self.chars += len(word)
        return at

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.model.langs))
        block = len(self.rows) // 2
        for a in range(0, len(words), block):
            part = words[a : a + block]
            if len(self) + len(part) > len(self.rows) or self.chars > self.most_chars:
                self.clear()
                self.chars = 0
            out += self.rows[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(0, dtype=float)
        return out


def fit(docs: DataFrame, trainable: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts a model on at most about ``sample`` of the rows for which ``trainable`` holds; rows without a language or text do not count."""
    own = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), trainable.alias("_ok")).filter("_ok AND lang IS NOT NULL AND text IS NOT NULL")
    total = own.count()
    share = min(1.0, sample / max(total, 1))
    chosen = own.filter(F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))
    words = chosen.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "language-words")
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    cut = lambda k: F.when(F.length(padded) >= k, F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = words.select("lang", "n", F.explode(F.concat(*[cut(k) for k in SIZES])).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)
    got: list[dict[str, dict[str, int]]] = [{}, {}]
    for out, rows in zip(got, (words.filter(F.col("n") >= MIN_COUNT), grams), strict=True):
        for r in rows.toArrow().to_pylist():
            out.setdefault(r["word"], {})[r["lang"]] = r["n"]
    langs = sorted({x for c in got for v in c.values() for x in v})
    return Model(langs, *got)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the posterior under equal priors.

    Nulls: a null text, or one without a letter, is ``und`` with score 0, as is everything if the model knows no language.
    Equal scores go to the first language in code-point order. Repeated rows are scored each; an empty table gives no
    rows; texts of any length are read whole. Only the id and the text are read, so other names cannot clash.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        rows = _Table(known)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text"):
                runs = letter_runs(text.as_py())
                if not known.langs or not any(w.isalpha() for w in runs):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = rows.total(runs)
                best = int(total.argmax())
                langs.append(known.langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op9_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    out = predict(docs, fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_word_backoff": op9_word_backoff}
ORACLE: dict[str, str] = {}
