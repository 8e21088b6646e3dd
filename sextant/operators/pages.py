"""Pages: bytes to text, main text by block densities, registered domains by suffix rules, robots rules as a table.

A page is read into blocks once, some pages at a time; which blocks are its main text is decided by expressions over their word
counts and link densities. Suffix and robots rules are tables that urls are joined with.
"""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .ingest import is_feed, main_text

# Words that a main text must have more than; tags whose content is no text of the page.
LEAST_WORDS = 60
DROPPED = frozenset(["script", "style", "noscript", "header", "footer", "nav", "form", "iframe", "svg"])
#: Tags that words run through; any other tag ends a block.
INLINE = frozenset(["a", "abbr", "b", "cite", "code", "em", "font", "i", "img", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u", "wbr"])
#: Tags without an end.
EMPTY = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])

BLOCK = "struct<tag:string,text:string,words:int,linked:int>"


# --- bytes to text ---

_BOMS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
_DECLARED = re.compile(rb"""(?:charset|encoding)\s*=\s*["']?\s*([A-Za-z0-9_.:-]{2,40})""", re.IGNORECASE)


def decoded(content: bytes, content_type: str = "") -> str:
    """The text of a page's bytes: by its byte order mark, else UTF-8 if it is that, else what the header or the first 4,096
    bytes declare, else Windows-1252. Bytes that no character has become replacement marks."""
    for bom, name in _BOMS:
        if content.startswith(bom):
            return content[len(bom) :].decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        pass
    for place in (content_type.encode("ascii", "ignore"), content[:4096]):
        said = _DECLARED.search(place)
        if said:
            try:
                return content.decode(said[1].decode("ascii"), "replace")
            except LookupError:  # no such encoding
                continue
    return content.decode("cp1252", "replace")


# --- main text ---


class _Reader(HTMLParser):
    """Blocks of a page in order, with their words and those of them inside links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.blocks = "", []
        self.tag, self.words, self.linked, self.link, self.dropped = "", [], 0, 0, []

    def handle_starttag(self, tag, attrs):
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.append(tag)
            return
        if tag in DROPPED:
            self._close()
            self.dropped = [tag]
        elif tag == "a":
            self.link += 1
        elif tag not in INLINE:
            self._close()
            if tag not in EMPTY:
                self.tag = tag

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag not in INLINE:
            self._close()
            self.tag = ""

    def handle_data(self, data):
        if not self.dropped:
            words = data.split()
            glued = self.words and words and not data[0].isspace() and not self.spaced
            if glued:
                self.words[-1] += words.pop(0)
            self.words += words
            self.linked += len(words) if self.link else 0
            if data:
                self.spaced = data[-1].isspace()

    spaced = True

    def _close(self):
        if self.words:
            text = " ".join(self.words)
            if self.tag == "title":
                self.title = self.title or text
            else:
                self.blocks.append((self.tag, text, len(self.words), min(self.linked, len(self.words))))
        self.words, self.linked, self.spaced = [], 0, True


def read_blocks(html: str | None) -> tuple[str, list[tuple[str, str, int, int]]]:
    """(title, blocks) of a page; a block is (tag, text, words, words in links)."""
    reader = _Reader()
    reader.feed(re.sub(r"<[A-Za-z/!][^<>]*\Z", "", html or ""))  # a tag that is cut off is no text
    reader.close()
    reader._close()
    return reader.title, reader.blocks


def is_content(blocks: Column) -> Column:
    """Which blocks of an array are main text, as an array of booleans.

    A decision tree over shallow features (Kohlschuetter, Fankhauser, Nejdl: Boilerplate Detection Using Shallow Text Features,
    2010): a block of few linked words counts if it is long, or if its neighbours make it likely.
    """
    density = lambda b: F.coalesce(b["linked"] / b["words"], F.lit(0.0))
    count = lambda b: F.coalesce(b["words"], F.lit(0))

    def one(b: Column, i: Column) -> Column:
        before, after = F.get(blocks, i - 1), F.get(blocks, i + 1)
        beside_text = (count(b) > 16) | (count(after) > 15) | (count(before) > 4)
        beside_links = (count(b) > 40) | (count(after) > 17)
        return (density(b) <= 1 / 3) & F.when(density(before) <= 5 / 9, beside_text).otherwise(beside_links)

    return F.transform(blocks, one)


def main_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, main_text, words, way, n_blocks, n_content): title and content blocks where they have more than 60 words (``density``),
    else title, headings and long paragraphs (``fallback``), of feeds and site maps titles and descriptions (``feed``).

    A null page has the empty text. Every page is read whole.
    """
    read = f"struct<title:string,blocks:array<{BLOCK}>,feed:boolean,plain:string>"

    # no Arrow: its batches would hold 10,000 pages and their blocks at once
    @F.udf(read, useArrow=False)
    def run(page: str | None) -> tuple:
        title, blocks = read_blocks(page)
        return title, blocks, bool(page) and is_feed(page), main_text(page)

    rows = pages.select(F.col(id_col), run(html_col).alias("r")).select(id_col, "r.*").withColumn("keep", is_content(F.col("blocks")))
    kept = F.transform(F.filter(F.arrays_zip("blocks", "keep"), lambda z: z["keep"]), lambda z: z["blocks"]["text"])
    text = F.array_join(F.filter(F.concat(F.array("title"), kept), lambda x: x != ""), "\n\n")
    rows = rows.withColumn("dense", text).withColumn("n", T.word_count(text))
    way = F.when(F.col("n") > LEAST_WORDS, "density").when(F.col("feed"), "feed").otherwise("fallback")
    rows = rows.withColumn("way", way).withColumn("main_text", F.when(F.col("way") == "density", F.col("dense")).otherwise(F.col("plain")))
    return rows.select(id_col, "main_text", T.word_count(F.col("main_text")).alias("words"), "way", F.size("blocks").alias("n_blocks"), F.size(kept).alias("n_content"))


# --- registered domains ---


def suffix_rules(rules: DataFrame) -> DataFrame:
    """(suffix, kind, labels) of rules (rule) as public suffix lists write them: ``a.b``, ``*.b`` for any label before b, ``!a.b``
    for an exception. Blank lines and comments are left out."""
    rule = F.lower(F.trim("rule"))
    rows = rules.select(rule.alias("rule")).filter("rule <> '' AND NOT startswith(rule, '//')").distinct()
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("plain")
    bare = F.regexp_replace("rule", r"^(!|\*\.)", "")
    return rows.select(bare.alias("suffix"), kind.alias("kind"), (F.size(F.split(bare, r"\.")) + F.when(kind == "wildcard", 1).when(kind == "exception", -1).otherwise(0)).alias("labels"))


def registered_domains(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, suffix, domain): the public suffix of each url's host by the longest of the rules (rule) that fits, an exception
    before all others, the last label if none does; the domain is one label more, null for a host that is itself a suffix.

    Hosts are looked up once each, by an equi join of their ends with the rules. A host of numbers is its own domain and has no
    suffix. A null url, or one without a host, has nulls.
    """
    own = urls.select(F.col(id_col), F.nullif(F.regexp_replace(T.host(F.col(url_col)), r"\.$", ""), F.lit("")).alias("host"))
    number = F.col("host").rlike(r"^[0-9.]+$|^\[")
    hosts = own.select("host").filter(F.col("host").isNotNull() & ~number).distinct().withColumn("l", F.split("host", r"\."))
    n = F.size("l")
    ends = hosts.select("host", "l", F.explode(F.sequence(F.lit(1), n)).alias("k")).withColumn("suffix", F.array_join(F.slice("l", n - F.col("k") + 1, F.col("k")), "."))
    hit = ends.join(suffix_rules(rules), "suffix").filter("labels <= size(l)")
    best = hit.groupBy("host").agg(F.max(F.struct((F.col("kind") == "exception").alias("e"), "labels")).alias("b"))
    told = hosts.join(best, "host", "left").select("host", "l", F.coalesce("b.labels", F.lit(1)).alias("labels"))
    end = lambda k: F.array_join(F.slice("l", F.greatest(n - k + 1, F.lit(1)), k), ".")
    told = told.select("host", end(F.col("labels")).alias("suffix"), F.when(F.col("labels") < n, end(F.col("labels") + 1)).alias("_domain"))
    out = own.join(told, "host", "left")
    return out.select(id_col, "host", "suffix", F.when(number, F.col("host")).otherwise(F.col("_domain")).alias("domain"))


# --- robots ---


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, pattern, allow) of robots files (host, text): each rule of a group once for each agent that the group names,
    lower-cased. Lines that are neither agents nor rules, comments, and rules without a path say nothing."""
    line = files.select("host", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n?|\n")).alias("at", "line"))
    line = line.select("host", "at", F.regexp_extract("line", r"(?i)^\s*(user-agent|allow|disallow)\s*:\s*([^#]*)", 1).alias("f"), F.trim(F.regexp_extract("line", r"(?i)^\s*(user-agent|allow|disallow)\s*:\s*([^#]*)", 2)).alias("value"))
    line = line.filter("f <> ''").withColumn("agent_line", F.lower("f") == "user-agent")
    # a file is one row before it is split, so a window over its lines is no larger than that
    w = W.partitionBy("host").orderBy("at")
    starts = F.col("agent_line") & ~F.coalesce(F.lag("agent_line").over(w), F.lit(False))
    line = line.withColumn("starts", starts.cast("int")).withColumn("part", F.sum("starts").over(w))
    agents = line.filter("agent_line").select("host", "part", F.lower("value").alias("agent")).distinct()
    rules = line.filter("NOT agent_line AND value <> ''").select("host", "part", F.col("value").alias("pattern"), (F.lower("f") == "allow").alias("allow"))
    return agents.join(rules, ["host", "part"], "left").select("host", "agent", "pattern", "allow").distinct()


def path_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: ``*`` is any text, ``$`` at the end is the end."""
    literal = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^|])", r"\\$1")
    literal = F.regexp_replace(F.regexp_replace(literal, r"\*+", ".*"), r"\$(?!$)", r"\\\$")
    return F.concat(F.lit("(?s)^"), literal)


def robots_verdicts(urls: DataFrame, rules: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """``urls`` with ``rule`` and ``allowed`` by ``rules`` (host, agent, pattern, allow): of the host's rules for ``agent``, or for ``*`` if it
    names no such agent, the longest pattern that fits the path and query decides, allow before disallow of the same length; a
    host without rules, and a url that none fits, is allowed.

    Only the rules of this agent are joined, by host. Each (host, path) is judged once.
    """
    mine, any_ = F.col("agent") == agent.lower(), F.col("agent") == "*"
    own = rules.filter(mine | any_).withColumn("_own", mine)
    best = own.groupBy("host").agg(F.max("_own").alias("_most"))
    chosen = own.join(best, "host").filter("_own = _most AND pattern IS NOT NULL").select(F.col("host").alias("_host"), "pattern", "allow").distinct()
    # rules of a host are few: they are one row beside its urls
    packed = chosen.groupBy("_host").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", "pattern", path_regex(F.col("pattern")).alias("regex"))).alias("_rules"))
    path = F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    rows = urls.withColumn("_h", T.host(F.col(url_col))).withColumn("_path", path)
    rows = rows.join(packed, F.col("_h") == F.col("_host"), "left")
    hit = F.array_max(F.transform(F.filter("_rules", lambda r: F.rlike(F.col("_path"), r["regex"])), lambda r: F.struct(r["n"], r["allow"], r["pattern"])))
    return rows.withColumn("_hit", hit).select(*urls.columns, F.col("_hit.pattern").alias("rule"), F.coalesce("_hit.allow", F.lit(True)).alias("allowed"))
