"""URL filters: every glob rule is simulated at once by a bit-parallel automaton (multiword Shift-And).

A pattern has one bit before its first character and one after each; all patterns lie end to end in a row of 64-bit words.
Per character class ``c`` there are two masks: ``step[c]``, the states that reading c may enter from the state before, and
``stay[c]``, the states that a star lets c stay in. Reading c: ``D = ((D << 1) & step[c]) | (D & stay[c])`` with the shift
carried across words. First states are never in ``step``, so neighbours in the row do not disturb each other. A batch of
urls advances together, one position at a time, in numpy.

Globs are written over ``host/path``: ``?`` is one character other than /, ``*`` any run without /, ``**`` any run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host and path prefix, verdict): a rule fits its host and all subdomains; the longest that fits decides.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Globs that block where no rule fits; what neither matches is allowed.
BLOCKED = ["**ads-track**", "**doubleclick**", "ads.**", "*.ads.**", "**/ads/**", "**/banner?/**", "**/track/**", "**.exe"]
DEFAULT = "allow"
#: States and answers of the urls that advance together take so much, however many rules there are.
STATE_BYTES = 64 << 20

_ONE = np.uint64(1)


class Automaton:
    """Masks of a list of globs; ``match`` tells which of them fit each string as a whole."""

    def __init__(self, globs: list[str]):
        first, last, atoms = [], [], []  # atoms: (literal or "?" or None for a first state, star: 0, 1 or 2)
        for glob in globs:
            first.append(len(atoms))
            atoms.append([None, 0])
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    wide = glob[i : i + 2] == "**"
                    atoms[-1][1] = max(atoms[-1][1], 1 + wide)
                    i += 1 + wide
                else:
                    atoms.append([glob[i], 0])
                    i += 1
            last.append(len(atoms) - 1)
        self.words = max(1, -(-len(atoms) // 64))
        literals = sorted({a for a, _ in atoms if a and a != "?"} | {"/"})
        self.codes = np.array([ord(c) for c in literals], np.uint32)
        kinds = [*literals, ""]  # the last class: every other character
        self.step, self.stay = (np.zeros((len(kinds), self.words), np.uint64) for _ in range(2))
        for at, (literal, star) in enumerate(atoms):
            bit = _ONE << np.uint64(at % 64)
            for k, c in enumerate(kinds):
                if literal is not None and (literal == c or literal == "?" and c != "/"):
                    self.step[k, at // 64] |= bit
                if star == 2 or star == 1 and c != "/":
                    self.stay[k, at // 64] |= bit
        self.start = np.zeros(self.words, np.uint64)
        for at in first:
            self.start[at // 64] |= _ONE << np.uint64(at % 64)
        self.last = last
        #: Strings that may advance together within STATE_BYTES.
        self.rows = max(1, STATE_BYTES // (8 * self.words + len(globs)))

    def classes(self, chars: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, chars), len(self.codes) - 1)
        return np.where(self.codes[at] == chars, at, len(self.codes))

    def match(self, strings: list[str]) -> np.ndarray:
        """Booleans, strings x globs. Strings advance in order of length, so short ones leave early."""
        size = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-size, kind="stable")
        chars = self.classes(np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32))
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        state = np.tile(self.start, (len(strings), 1))
        active = len(strings)
        for pos in range(int(size[0]) if len(size) else 0):
            while size[active - 1] <= pos:
                active -= 1
            c, d = chars[begin[:active] + pos], state[:active]
            moved = d << _ONE
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.empty((len(strings), len(self.last)), bool)
        for k, at in enumerate(self.last):
            out[order, k] = (state[:, at // 64] >> np.uint64(at % 64)) & _ONE != 0
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ://."""
    rest = (url or "").partition("://")[2]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, path = rest[:cut], rest[cut:]
    cut = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host.translate({c: c + 32 for c in range(65, 91)}), path[:cut]


def rule_glob(rule: str) -> str:
    """A rule as a glob over ``.host/path``: the host's end, then the path's beginning. The first / of such a string ends its host."""
    return f"*.{rule}**"


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked: list[str] = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    Nulls: a null url has an empty host and path, fits no rule and gets the default verdict. Rules of equal length cannot
    both fit unless they are the same text; the first listed counts. Repeated rows are judged each; an empty table gives no
    rows; urls of any length are read whole. Only the id and the url are read, so other names cannot clash.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    # all are asked of ".host/path", in one pass: so a whole host and its subdomains look alike, and a blocked glob of "host/path" follows the stop
    globs = [*(rule_glob(r) for r, _ in ranked), *(f".{g}" for g in blocked)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for batch in (whole.slice(at, machine.rows) for whole in batches for at in range(0, whole.num_rows, machine.rows)):
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            fits = machine.match([f".{h}{p}" for h, p in parts])
            hit, bad = fits[:, : len(ranked)], fits[:, len(ranked) :].any(1)
            first = np.where(hit.any(1), hit.argmax(1), -1) if ranked else np.full(len(parts), -1)
            rule = [ranked[k][0] if k >= 0 else None for k in first]
            verdict = [ranked[k][1] if k >= 0 else "block" if b else DEFAULT for k, b in zip(first, bad, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = own.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op5_glob_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _glob_regex(glob: str) -> str:
    out = glob.replace("**", "\0").replace("*", "\1")
    for c in "\\.+()[]{}^$|":
        out = out.replace(c, "\\" + c)
    return "^" + out.replace("?", "[^/]").replace("\0", "(?s:.*)").replace("\1", "[^/]*") + "$"


def _oracle() -> str:
    fits = lambda r: f"(('.' || host) LIKE '%.{r.split('/')[0]}' AND starts_with(path, '/{r.split('/', 1)[1]}'))"
    ranked = sorted(RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in ranked)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in ranked)
    bad = " OR ".join(f"regexp_matches(host || path, '{_glob_regex(g)}')" for g in BLOCKED)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS t FROM pages),
split AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {rule} END AS rule FROM split)
SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN {bad} THEN 'block' ELSE '{DEFAULT}' END END AS verdict FROM ruled"""


QUERIES = {"op5_glob_automaton": op5_glob_automaton}
ORACLE = {"op5_glob_automaton": _oracle()}
