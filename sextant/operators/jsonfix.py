"""Repair of JSON that models and cut-off transfers leave behind.

Rows that parse are not touched and never leave the JVM. The others go through a tokenising automaton that knows which brackets
are open and what may come next; what it cannot read goes to a fixer that the caller passes in, up to five times, and is the
empty object if that fails too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How often a fixer is asked; what stands for a text that cannot be repaired.
TRIES, NOTHING = 5, "{}"

_TOKEN = re.compile(r"""[{}\[\]:,]|"(?:[^"\\]|\\.)*"?|'(?:[^'\\]|\\.)*'?|//[^\n]*|/\*.*?(?:\*/|\Z)|[^\s{}\[\]:,"']+""", re.DOTALL)
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\Z")
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.?)", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_MISSING = object()


def _string(token: str) -> str:
    """The text of a quoted token, closed or not; unknown escapes stand for themselves."""
    inner = token[1:-1] if len(token) > 1 and token[-1] == token[0] and not re.search(r"(?<!\\)(?:\\\\)*\\\Z", token[:-1]) else token[1:]
    text = _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _PLAIN.get(m[1], m[1]), inner)
    return re.sub("[\ud800-\udfff]", "", text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def _scalar(token: str):
    if token[0] in "\"'":
        return _string(token)
    if token.lower() in _WORDS:
        return _WORDS[token.lower()]
    if _NUMBER.match(token):
        number = token.lstrip("+")
        try:
            return int(number)
        except ValueError:
            value = float(number)
            return value if abs(value) != float("inf") else number
    return token


class _Builder:
    """The open containers and what the innermost one waits for."""

    def __init__(self):
        self.root, self.open, self.keys = _MISSING, [], []

    def put(self, value) -> None:
        if not self.open:
            if self.root is _MISSING:
                self.root = value
        elif isinstance(self.open[-1], list):
            self.open[-1].append(value)
        elif self.keys[-1] is _MISSING:  # the first of a pair is its key, whatever it is
            self.keys[-1] = value if isinstance(value, str) else json.dumps(value)
        else:
            self.open[-1][self.keys[-1]] = value
            self.keys[-1] = _MISSING

    def begin(self, container) -> None:
        if self.open and isinstance(self.open[-1], dict) and self.keys[-1] is _MISSING:
            return  # a container where a key belongs says nothing
        self.put(container)
        if self.open or self.root is container:
            self.open.append(container)
            self.keys.append(_MISSING)

    def gap(self) -> None:
        """A key whose pair ends without a value has null."""
        if self.open and isinstance(self.open[-1], dict) and self.keys[-1] is not _MISSING:
            self.put(None)

    def end(self, kind: type) -> None:
        """Closes the innermost container of a kind, and those inside it that were left open; none, if there is none."""
        if not any(isinstance(c, kind) for c in self.open):
            return
        while True:
            self.gap()
            self.keys.pop()
            if isinstance(self.open.pop(), kind):
                return


def mended(text: str | None) -> str | None:
    """The first object or list of a text as JSON, or None if it has neither.

    What stands before it is skipped, and after it left out. Quotes may be single, keys and values bare words, literals those of
    other languages; commas may be missing or too many, comments are dropped, and what is open at the end is closed.
    """
    at = re.search(r"[{\[]", text or "")
    if not at:
        return None
    b = _Builder()
    words: list[str] = []

    def flush() -> None:
        # bare words side by side are one text, but numbers and literals in a list are values without commas
        if words and b.open and isinstance(b.open[-1], list) and not any(isinstance(_scalar(w), str) for w in words):
            for w in words:
                b.put(_scalar(w))
        elif words:
            b.put(_scalar(words[0]) if len(words) == 1 else " ".join(words))
        words.clear()

    for m in _TOKEN.finditer(text, at.start()):
        t = m[0]
        if t[:2] in ("//", "/*"):
            continue
        if t[0] not in "{}[]:,\"'":
            words.append(t)
            continue
        flush()
        if t in "{[":
            b.begin({} if t == "{" else [])
        elif t in "}]":
            b.end(dict if t == "}" else list)
            if not b.open:
                break
        elif t == ",":
            b.gap()
        elif t != ":":
            b.put(_scalar(t))
    flush()
    while b.open:
        b.gap()
        b.open.pop()
        b.keys.pop()
    return json.dumps(b.root, ensure_ascii=False, allow_nan=False)


def parses(text: str | None) -> bool:
    try:
        json.loads(text)
        return True
    except (TypeError, ValueError):
        return False


def fixed(text: str | None, fixer: Callable[[str], str] | None, tries: int = TRIES) -> tuple[str, str]:
    """(JSON, way) of a text that does not parse: by the automaton, by the fixer, or the empty object."""
    by_rules = mended(text)
    if by_rules is not None:
        return by_rules, "mended"
    for _ in range(tries if fixer and text else 0):
        try:
            said = fixer(text)
        except Exception:  # an answer that does not come is no answer
            continue
        if parses(said):
            return said, "fixer"
    return NOTHING, "nothing"


def is_json(c: Column) -> Column:
    return c.isNotNull() & F.try_parse_json(c).isNotNull()


def repaired(rows: DataFrame, col: str, fixer: Callable[[str], str] | None = None, tries: int = TRIES) -> DataFrame:
    """``rows`` with ``repaired``, JSON in any case, and ``way``: ``whole`` for a text that parses, as it is; else ``mended``,
    ``fixer`` or ``nothing``. A null is nothing."""
    good = F.coalesce(is_json(F.col(col)), F.lit(False))

    @F.pandas_udf("struct<repaired:string,way:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fixed(t, fixer, tries) for t in texts], columns=["repaired", "way"])

    # two branches: a column of both would send every row to Python
    whole = rows.filter(good).select(*rows.columns, F.col(col).alias("repaired"), F.lit("whole").alias("way"))
    broken = rows.filter(~good).select(*rows.columns, run(col).alias("_r")).select(*rows.columns, "_r.repaired", "_r.way")
    return whole.union(broken)

