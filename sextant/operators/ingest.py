"""Crawl and fetch contracts, resume, catalogue lookups and backfills. Network and model calls are functions that callers pass in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import word_count
from .order import positions


class _Blocks(HTMLParser):
    """Title, then h1-h3 of more than 5 characters, then paragraphs of more than 40; dropped tags and their content don't count."""

    # Tags whose content is no text of the page.
    DROPPED = {"script", "style", "noscript", "header", "footer", "nav", "form", "iframe", "svg"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.heads, self.paragraphs = "", [], []
        self.inside, self.dropped, self.buffer = None, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.dropped += 1
        elif tag in ("title", "h1", "h2", "h3", "p"):
            self._close()
            self.inside = tag

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag == self.inside:
            self._close()

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.buffer.append(data)

    def _close(self):
        text = " ".join("".join(self.buffer).split())
        if self.inside == "title":
            self.title = self.title or text
        elif self.inside == "p" and len(text) > 40:
            self.paragraphs.append(text)
        elif self.inside in ("h1", "h2", "h3") and len(text) > 5:
            self.heads.append(text)
        self.inside, self.buffer = None, []


class _Feed(HTMLParser):
    """Titles of more than 5 characters, then descriptions and summaries of more than 40, of feeds and site maps."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.heads, self.bodies, self.inside, self.buffer = [], [], None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "description", "summary"):
            self.inside, self.buffer = tag, []

    def handle_endtag(self, tag):
        if tag == self.inside:
            text = " ".join("".join(self.buffer).split())
            if len(text) > (5 if tag == "title" else 40):
                (self.heads if tag == "title" else self.bodies).append(text)
            self.inside = None

    def handle_data(self, data):
        if self.inside:
            self.buffer.append(data)

    def unknown_decl(self, data):
        self.handle_data(data.removeprefix("CDATA["))


def is_feed(text: str) -> bool:
    head = text.lstrip()[:400].lower()
    return head.startswith("<?xml") or any(x in head for x in ("<rss", "<feed", "<urlset", "<sitemapindex"))


def main_text(html: str | None) -> str:
    """The text of a page: title, headings, then paragraphs; of a feed its titles and descriptions, each once."""
    if html and is_feed(html):
        feed = _Feed()
        feed.feed(html)
        return "\n\n".join(dict.fromkeys([*feed.heads, *feed.bodies]))
    parser = _Blocks()
    parser.feed(html or "")
    parser._close()
    return "\n\n".join(x for x in [parser.title, *parser.heads, *parser.paragraphs] if x)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, main_text, words) by a real parser, some pages at a time: an Arrow batch would hold 10,000 of any length."""
    extract = F.udf(main_text, "string", useArrow=False)
    return pages.select("page_id", extract("html").alias("main_text")).withColumn("words", word_count(F.col("main_text")))


def outcomes(pages: DataFrame, least: int) -> DataFrame:
    """Successes and failures of a crawl in one schema: columns that only one kind has are null in the other."""
    text = F.regexp_replace("html", r"(?s)<[^>]*>", " ")
    rows = pages.select("page_id", F.col("url").alias("website"), word_count(text).alias("words"))
    good = F.col("words") >= least
    return rows.select(
        "page_id",
        "website",
        F.when(good, "ok").otherwise("fail").alias("status"),
        F.when(~good, "too_short_or_empty").alias("reason"),
        F.when(good, F.md5("website")).alias("doc_id"),
        F.when(good, F.col("words")).alias("words"),
    )


def harvest(urls: DataFrame, fetch: Callable[[str], tuple[str, str, bytes]], allowed: Callable[[str], bool] = lambda u: True, pause: float = 0.0) -> DataFrame:
    """(url, final_url, content, reason): one fetch per row, politely: rows of a host come to one task, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                try:
                    if not allowed(url):
                        rows.append((url, None, None, "robots_disallow"))
                        continue
                    final, _, content = fetch(url)
                    rows.append((url, final, content, None))
                except Exception as e:  # a failed fetch is a row, not a failed job
                    rows.append((url, None, None, f"fetch_error:{type(e).__name__}"))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["url", "final_url", "content", "reason"])

    return urls.select("url").repartition(F.regexp_extract("url", r"://([^/?#:]*)", 1)).mapInPandas(run, "url string, final_url string, content binary, reason string")


def retried(call: Callable, tries: int = 4, wait: Callable[[int], float] = lambda n: 1.5 * (n + 1)) -> Callable:
    """``call`` with up to ``tries`` attempts; the last error is raised."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait(n))

    return run


def routed(pages: DataFrame, summary_host: str) -> DataFrame:
    """Each row goes to one of two fetchers: two filtered branches, since a CASE would run both for every row."""
    mine = F.coalesce(F.col("url").contains(summary_host), F.lit(False))
    branch = lambda rows, route: rows.select("page_id", F.lit(route).alias("route"), F.substring("html", 1, 5000).alias("text"), F.when(F.col("html").isNotNull() & (F.col("html") != ""), "ok").otherwise("error").alias("status"), F.sha2("url", 256).alias("doc_id"))
    return branch(pages.filter(mine), "summary").union(branch(pages.filter(~mine), "page"))


def pending(rows: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key, of one column or several, is not done; keys with a null stay."""
    keys = [key] if isinstance(key, str) else key
    return rows.join(done.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def next_batches(rows: DataFrame, done: DataFrame, key: str, size: int, batch_col: str | None = None) -> DataFrame:
    """(key, batch) of pending rows: batches of ``size`` rows by position, numbered on from the last finished batch.

    That is the largest number in ``batch_col`` of ``done`` if there is one; else ``done`` is taken to fill batches from 0 on, as
    many as its keys need. Gaps in the keys leave no batch short and no number out.
    """
    if batch_col:
        first = done.agg((F.coalesce(F.max(batch_col), F.lit(-1)) + 1).alias("_first"))
    else:
        first = done.agg(F.ceil(F.count_distinct(key) / F.lit(size)).alias("_first"))
    todo = positions(pending(rows.select(key), done, key), [key], name="_at")
    return todo.crossJoin(F.broadcast(first)).select(key, (F.col("_first") + F.floor(F.col("_at") / size)).cast("long").alias("batch"))


def complete(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows that have all of the columns: nulls are dropped with their whole row, so columns never shift against each other."""
    return rows.dropna(subset=list(columns))


def labelled(rows: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a label for each id column from one dimension (id, name); a null id or missing label gives null."""
    for key, label in columns.items():
        rows = rows.join(names.select(F.col("id").alias(key), F.col("name").alias(label)), key, "left")
    return rows


def first_match(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first in ``order``."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_k = 1").drop("_k")


def hashed_embedding(text: str, width: int = 16) -> list[float]:
    """A deterministic stand-in for a sentence encoder."""
    digest = hashlib.sha256(text.encode()).digest()
    return [b / 255 for b in digest[:width]]


def hashed_embeddings(texts: list[str]) -> list[list[float]]:
    return [hashed_embedding(t) for t in texts]


def backfilled(docs: DataFrame, have: DataFrame | None, embed: Callable[[list[str]], list[list[float]]] = hashed_embeddings, key: str = "doc_id", size: int = 32) -> DataFrame:
    """(doc_id, embedding, status) of documents without an embedding (of all if ``have`` is None), encoded ``size`` at a time.

    A null or empty text gives an empty list, status ``empty``; a failed call gives empty lists for its texts and the reason.
    """

    @F.pandas_udf("struct<embedding:array<float>,status:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple[list[float], str]] = [([], "empty")] * len(texts)
        at = [i for i, t in enumerate(texts) if t]
        for k in range(0, len(at), size):
            part = at[k : k + size]
            try:
                got = [([float(x) for x in v], "ok") for v in embed([texts.iloc[i] for i in part])]
            except Exception as e:
                got = [([], f"error:{type(e).__name__}")] * len(part)
            for i, v in zip(part, got, strict=False):
                out[i] = v
        return pd.DataFrame(out, columns=["embedding", "status"])

    missing = docs if have is None else docs.join(have.select(F.col("vec_id").alias(key)), key, "left_anti")
    return missing.select(key, run("text").alias("e")).select(key, "e.embedding", "e.status")
