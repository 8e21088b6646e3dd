"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary is that of a byte-pair model: a sequence of pieces is the encoding of its text exactly if every piece is its
own encoding and every two neighbours are the encoding of their concatenation. So encoding is a best-path problem: from
state (end of last piece, last piece) to the next with weight score(piece) if the two are compatible and minus infinity if
not. A chunk of a text maps entry states to exit states; that transfer matrix over (max, +) can be computed without knowing
what comes before, matrices combine associatively, and once the scan has told every chunk its entry and exit state, each
chunk finds its own pieces. No piece holds a space mark after another character, so at the beginning of a word all states
become one and matrices stay small: from there on a chunk is the same whatever precedes it.

Documents of up to CHUNK characters are a single chunk with known entry state; longer ones become rows, one per chunk. The scan
is a tree over them: products of SPAN neighbouring matrices, products of SPAN of those, and so on as often as the longest text
needs; then the states at the borders are passed down, every node in a task of its own. No task holds more than SPAN matrices.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

MARK = "▁"
CHUNK = 32_768
#: Neighbouring matrices that one task combines.
SPAN = 16
#: Words, characters of words and answers on neighbours that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_CHARS, REMEMBERED_PAIRS = 800_000, 8_000_000, 2_000_000
#: Words with so many equal first characters share the states up to there.
HEAD = 6
#: The state at a word's beginning, and at the beginning of the text.
FREE = (0, "")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and the compatibility of neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.ids))
        assert not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids), "a piece goes on into the next word"
        #: What each id stands for, as UTF-8.
        self.spelling = self._spelling(set(plain))
        self.split = splitter(set(self.ids)).findall
        #: Ends of pieces: what is none of them is no end of a longer piece either.
        self.suffixes = {p[k:] for p in self.ids for k in range(len(p))}
        #: States of the first HEAD characters of longer words.
        self.heads: dict[str, tuple[list, list, list]] = {}
        #: piece -> piece -> whether it may follow, and how many such answers there are.
        self.after: dict[str, dict[str, bool]] = {}
        self.answers = 0
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        #: Words met lately, and those met before them.
        self.words: dict[str, bytes] = {}
        self.word_chars = 0
        self.older: dict[str, bytes] = {}

    def _spelling(self, plain: set[int]) -> list[bytes]:
        out = [p.replace(MARK, " ").encode() if i in plain else b"" for i, p in enumerate(self.pieces)]
        for b, i in self.byte_ids.items():
            out[i] = bytes([b])
        return out

    def merged(self, text: str) -> list[str]:
        """The byte-pair encoding of a short string by its definition: the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a ("": nothing or another word)."""
        if not a or a not in self.ids or b not in self.ids or (b[0] == MARK and a[-1] != MARK):
            got = self._whole.get(b)
            if got is None:
                got = self._whole[b] = self.merged(b) == [b]
            return got
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) > REMEMBERED_PAIRS:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merged(a + b) == [a, b]
        return got

    def candidates(self, text: str, start: int) -> Iterator[str]:
        """The pieces that begin at a place of the text; a character without a piece of its own stands for its bytes."""
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            p = text[start:end]
            if p in self.ids or end == start + 1:
                yield p

    def weight(self, piece: str) -> float:
        return self.score.get(piece, -1e5)

    def id_bytes(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    # --- paths ---

    def paths(self, text: str, start: int, last: str, stop: int) -> dict[tuple[int, str], tuple[float, tuple[int, str] | None]]:
        """Best scores of the states (end, last piece) reached from (start, last) by pieces that begin before ``stop``."""
        best: dict[tuple[int, str], tuple[float, tuple[int, str] | None]] = {(start, last): (0.0, None)}
        at: dict[int, list[str]] = {start: [last]}
        for place in range(start, stop):
            for before in at.pop(place, ()):
                so_far = best[place, before][0]
                for p in self.candidates(text, place):
                    if self.compatible(before, p):
                        state, score = (place + len(p), p), so_far + self.weight(p)
                        old = best.get(state)
                        if old is None:
                            at.setdefault(state[0], []).append(p)
                        if old is None or score > old[0]:
                            best[state] = (score, (place, before))
        return best

    def word(self, word: str) -> bytes:
        """The ids of one word, as little-endian uint32; words met before are remembered."""
        got = self.words.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = self.id_bytes(self._best(word))
            if len(self.words) >= REMEMBERED or self.word_chars > REMEMBERED_CHARS:
                self.older, self.words, self.word_chars = self.words, {}, 0
            self.words[word] = got
            self.word_chars += len(word)
        return got

    def _best(self, word: str) -> list[str]:
        """The best path through a word of its own: a single entry state, so one state a place is enough (``paths`` without rows).

        States up to a place depend on the characters before it alone, so words with the same beginning share them.
        """
        if self.answers > REMEMBERED_PAIRS:
            self.after, self.heads, self.answers = {}, {}, 0
        n = len(word)
        if n > HEAD:
            got = self.heads.get(word[:HEAD])
            if got is None:
                if len(self.heads) >= REMEMBERED // 2:
                    self.heads.clear()
                got = self.heads[word[:HEAD]] = self._states(word, HEAD, [0.0], [""], [self._after("")])
            score, last, nexts = got[0][:], got[1][:], got[2][:]
        else:
            score, last, nexts = [0.0], [""], [self._after("")]
        self._states(word, n, score, last, nexts)
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def _after(self, piece: str) -> dict[str, bool]:
        got = self.after.get(piece)
        if got is None:
            got = self.after[piece] = {}
        return got

    def _states(self, word: str, stop: int, score: list, last: list, nexts: list) -> tuple[list, list, list]:
        """Continues the best scores and last pieces of a word's beginnings up to ``stop`` characters, in place."""
        weight, suffixes, low = self.score, self.suffixes, float("-inf")
        for end in range(len(score), stop + 1):
            best, piece = low, ""
            for start in range(end - 1, -1, -1):
                p = word[start:end]
                w = weight.get(p)
                if w is not None or start == end - 1:
                    so_far = score[start]
                    if so_far != low:
                        ok = nexts[start].get(p)
                        if ok is None:
                            ok = nexts[start][p] = self.compatible(last[start], p)
                            self.answers += 1
                        if ok and (total := so_far + (self.weight(p) if w is None else w)) > best:
                            best, piece = total, p
                if p not in suffixes:
                    break
            score.append(best)
            last.append(piece)
            nexts.append(self._after(piece) if piece else None)
        return score, last, nexts

    @staticmethod
    def _trace(best: dict, state: tuple[int, str]) -> list[str]:
        out = []
        while (before := best[state][1]) is not None:
            out.append(state[1])
            state = before
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """A text that is a single chunk."""
        known, word = self.words.get, self.word
        return b"".join([known(w) or word(w) for w in self.split(marked(text))]) if text else b""

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.spelling.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")

    # --- chunks ---

    def _first_word(self, text: str, begin: int, stop: int) -> int | None:
        """The first place from ``begin`` where a word begins, before ``stop``."""
        for i in range(max(begin, 1), stop):
            if text[i] == MARK and text[i - 1] != MARK:
                return i
        return None

    def entries(self, text: str, begin: int) -> list[tuple[int, str]]:
        """The states that may hold where a chunk begins: (characters that the last piece reaches beyond, last piece)."""
        if begin == 0 or (text[begin] == MARK and text[begin - 1] != MARK):
            return [FREE]
        out = []
        for start in range(max(0, begin - self.longest), begin):
            out += [(start + len(p) - begin, p) for p in self.candidates(text, start) if start + len(p) >= begin and self.compatible("", p)]
        return out

    def transfer(self, text: str, begin: int, stop: int) -> dict[tuple[int, str], dict[tuple[int, str], float]]:
        """The matrix of the chunk text[begin:stop]: entry state -> exit state -> best score. ``text`` holds context on both sides."""
        head = self._first_word(text, begin, stop)
        last_chunk = stop == len(text)

        def exits(best: dict) -> dict[tuple[int, str], float]:
            out: dict[tuple[int, str], float] = {}
            for (end, p), (score, _) in best.items():
                if end >= stop and (not last_chunk or end == stop):
                    state = (end - stop, p)
                    if not last_chunk and text[stop] == MARK and text[stop - 1] != MARK:
                        state = FREE
                    out[state] = max(score, out.get(state, float("-inf")))
            return out

        if head is None:
            return {s: row for s in self.entries(text, begin) if (row := exits(self.paths(text, begin + s[0], s[1], stop)))}
        # every way through the first part of a word ends where the next word begins; from there on all ways are one
        tail = max(i for i in range(head, stop) if text[i] == MARK and (i == head or text[i - 1] != MARK))
        middle = sum(self._word_score(w) for w in self.split(text[head:tail]))
        out_row = exits(self.paths(text, tail, "", stop))
        matrix = {}
        for s in self.entries(text, begin):
            if begin + s[0] > head:
                continue
            best = self.paths(text[:head], begin + s[0], s[1], head)
            ends = [v[0] for (end, _), v in best.items() if end == head]
            if ends:
                matrix[s] = {k: max(ends) + middle + v for k, v in out_row.items()}
        return matrix

    def _word_score(self, word: str) -> float:
        ids = memoryview(self.word(word)).cast("I")
        return sum(self.score.get(self.pieces[i], -1e5) for i in ids)

    def chunk_ids(self, text: str, begin: int, stop: int, entry: tuple[int, str], exit_: tuple[int, str]) -> bytes:
        """The ids of the pieces that begin in a chunk, between two known states."""
        head = self._first_word(text, begin, stop)
        free = lambda i: 0 < i < len(text) and text[i] == MARK and text[i - 1] != MARK

        def between(start: int, last: str, end: int, piece: str | None) -> bytes:
            best = self.paths(text[:end] if piece is None else text, start, last, min(end, stop))
            ends = [s for s in best if s[0] == end and (piece is None or s[1] == piece)]
            return self.id_bytes(self._trace(best, max(ends, key=lambda s: best[s][0])))

        at_end = (stop, None) if exit_ == FREE and (free(stop) or stop == len(text)) else (stop + exit_[0], exit_[1])
        if head is None:
            return between(begin + entry[0], entry[1], *at_end)
        tail = max(i for i in range(head, stop) if free(i) or i == head)
        first = between(begin + entry[0], entry[1], head, None) if begin + entry[0] < head else b""
        return first + b"".join(self.word(w) for w in self.split(text[head:tail])) + between(tail, "", *at_end)


def splitter(pieces: set[str]) -> re.Pattern:
    """Cuts a marked text where no piece can lie across: before a mark after another character, around line ends (if they have
    no piece), and between letters or digits and the signs that no piece joins to any of them."""
    signs = {c for p in pieces for c in p if not c.isalnum() and c not in (MARK, "_")}
    signs -= {x for p in pieces for c, d in zip(p, p[1:], strict=False) for x in (c, d) if c.isalnum() != d.isalnum()}
    line = "" if any("\n" in x for x in pieces) else "\n"
    p = re.escape("".join(sorted(signs | {"\0"})))
    run, other = f"(?:[{p}]+|[^\\W_]+)", f"(?:[^\\w{MARK}{line}{p}]|_)+"
    return re.compile(f"{MARK}*(?:{run}(?:{other}{run}?)*|(?:{other}{run}?)+)|{MARK}+" + (f"|{line}" if line else ""))


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def combine(a: dict, b: dict) -> dict:
    """The max-plus product of two transfer matrices."""
    out: dict = {}
    for s, row in a.items():
        got: dict = {}
        for mid, x in row.items():
            for t, y in b.get(mid, {}).items():
                got[t] = max(x + y, got.get(t, float("-inf")))
        if got:
            out[s] = got
    return out


def scan(matrices: list[dict], entry: tuple[int, str] = FREE, exit_: tuple[int, str] | None = None) -> list[tuple[tuple[int, str], tuple[int, str]]]:
    """(entry, exit) states of every matrix on the best path from ``entry`` to ``exit_`` (None: the best), by vectors from the left and one pass back."""
    vectors = [{entry: 0.0}]
    for m in matrices:
        vectors.append(combine({FREE: vectors[-1]}, m).get(FREE, {}))
    state = exit_ or max(vectors[-1], key=vectors[-1].get)
    out = []
    for v, m in zip(reversed(vectors[:-1]), reversed(matrices), strict=True):
        before = max((s for s in v if state in m.get(s, {})), key=lambda s: v[s] + m[s][state])
        out.append((before, state))
        state = before
    return out[::-1]


def dumped(matrix: dict) -> str:
    return json.dumps([[s, list(row.items())] for s, row in matrix.items()])


def loaded(matrix: str) -> dict:
    return {tuple(a): {tuple(t): x for t, x in row} for a, row in json.loads(matrix)}


def border_states(matrices: DataFrame, longest: int) -> DataFrame:
    """(row, k, states) of stored (row, k, matrix): the states at both ends of every chunk, k from 0 to at most ``longest`` - 1.

    Up the tree go products of ``SPAN`` neighbours, down it the states at their ends.
    """

    def multiplied(key, rows):
        product = functools.reduce(combine, map(loaded, rows.sort_by("k").column("matrix").to_pylist()))
        return pa.table({"row": rows["row"][:1], "k": pa.array([key[1].as_py()], pa.int32()), "matrix": [dumped(product)]})

    def within(rows):
        rows = rows.sort_by("k")
        ends = [tuple(x) for x in json.loads(rows["above"][0].as_py())] if "above" in rows.column_names else []
        states = scan([loaded(m) for m in rows["matrix"].to_pylist()], *ends)
        return pa.table({"row": rows["row"], "k": rows["k"], "states": pa.array([json.dumps(s) for s in states], pa.string())})

    out = "row long, k int, states string"
    if longest <= SPAN:
        return matrices.groupBy("row").applyInArrow(lambda rows: within(rows), out)
    parts = matrices.withColumn("part", F.floor(F.col("k") / SPAN).cast("int"))
    products = stored(parts.groupBy("row", "part").applyInArrow(multiplied, "row long, k int, matrix string"), "products")
    above = border_states(products, -(-longest // SPAN)).select("row", F.col("k").alias("part"), F.col("states").alias("above"))
    return parts.join(above, ["row", "part"]).groupBy("row", "part").applyInArrow(lambda rows: within(rows), out)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def crc_joined(a: int, b: int, size: int) -> int:
    """The crc32 of two strings one after the other from their own, and the second's length (GF(2) matrices)."""
    if not size:
        return a

    def times(matrix: list[int], v: int) -> int:
        out = 0
        for row in matrix:
            if not v:
                break
            if v & 1:
                out ^= row
            v >>= 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    n = 8 * size
    while n:
        if n & 1:
            a = times(step, a)
        step = [times(step, row) for row in step]
        n >>= 1
    return a ^ b


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_chunks, n_tokens, ids_crc32, decoded, ids) for every row: ids as the library gives them, and whether they decode to the text.

    ids_crc32 is over little-endian unsigned 32-bit ids. Nulls: a null text, like an empty one, has no ids and decodes to
    itself. A text that holds the space mark itself does not decode to itself, as in the library. Repeated rows are encoded
    each; an empty table gives no rows; texts of any length are encoded whole. Only the id and the text are read, so other
    names cannot clash. ``ids`` is null without ``with_ids``.
    """
    path = model or default_model()
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_chunks long, n_tokens long, ids_crc32 long, decoded boolean, ids array<int>"
    context = 32

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, crc, same, lists = [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = vocab.encode(text)
                    numbers = memoryview(ids).cast("I").tolist()
                    n.append(len(numbers))
                    crc.append(zlib.crc32(ids))
                    same.append(vocab.decode(numbers) == text)
                    lists.append(numbers if with_ids else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([1] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "n_chunks", "n_tokens", "ids_crc32", "decoded", "ids"])

    done = own.filter(F.length("text") <= chunk).mapInArrow(short, out)
    long = own.filter(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    count = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    rows = long.select("doc_id", "row", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), (count - 1).alias("last"))
    # a chunk of the marked text with its surroundings; the mark before the text is put on by the first chunk
    from_ = F.greatest(F.col("k") * chunk - context, F.lit(0))
    rows = rows.select("doc_id", "row", "k", "last", from_.alias("at"), F.substring("text", from_ + 1, F.lit(chunk) + (F.col("k") * chunk - from_) + context).alias("part"))
    rows = stored(rows, "chunks")

    def bounds(k: int, at: int, part: str, last: bool) -> tuple[str, int, int]:
        """The marked part and the chunk's place in it. The mark before the first chunk is one more character."""
        text = part.replace(" ", MARK)
        begin = k * chunk - at
        stop = len(text) if last else begin + chunk
        if at == 0:
            text, begin, stop = MARK + text, begin + (k > 0), stop + 1
        return text, begin, stop

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            got = []
            for k, last, at, part in zip(*(batch.column(c).to_pylist() for c in ("k", "last", "at", "part")), strict=True):
                got.append(dumped(vocab.transfer(*bounds(k, at, part, k == last))))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(got, pa.string())], ["row", "k", "matrix"])

    longest = (rows.agg(F.max("last")).first()[0] or 0) + 1
    states = border_states(stored(rows.mapInArrow(matrices, "row long, k int, matrix string"), "matrices"), longest)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            got = []
            for k, last, at, part, s in zip(*(batch.column(c).to_pylist() for c in ("k", "last", "at", "part", "states")), strict=True):
                entry, exit_ = (tuple(x) for x in json.loads(s))
                ids = vocab.chunk_ids(*bounds(k, at, part, k == last), entry, exit_)
                numbers = memoryview(ids).cast("I").tolist()
                got.append((len(numbers), zlib.crc32(ids), zlib.crc32(b"".join(map(vocab.spelling.__getitem__, numbers))), sum(len(vocab.spelling[i]) for i in numbers), numbers if with_ids else None))
            cols = list(zip(*got, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["row", "k", "n", "crc", "text_crc", "size", "ids"])

    parts = rows.join(states, ["row", "k"]).select("row", "k", "last", "at", "part", "states").mapInArrow(traced, "row long, k int, n long, crc long, text_crc long, size long, ids array<int>")

    def assembled(key, rows):
        rows = rows.sort_by("k").to_pydict()
        crc = text_crc = 0
        for c, t, n, size in zip(rows["crc"], rows["text_crc"], rows["n"], rows["size"], strict=True):
            crc, text_crc = crc_joined(crc, c, 4 * n), crc_joined(text_crc, t, size)
        ids = [i for part in rows["ids"] for i in part] if with_ids else None
        return pa.table({"row": rows["row"][:1], "n_chunks": [len(rows["k"])], "n_tokens": [sum(rows["n"])], "ids_crc32": [crc], "text_crc": [text_crc], "ids": pa.array([ids], pa.list_(pa.int32()))})

    whole = parts.groupBy("row").applyInArrow(assembled, "row long, n_chunks long, n_tokens long, ids_crc32 long, text_crc long, ids array<int>")
    # the decoded text, with the mark that encoding puts before it, has the checksum of the text after a space
    named = rows.filter("k = 0").select("row", "doc_id")
    first = _text_crcs(rows, chunk)
    big = whole.join(named, "row").join(first, "row").select("doc_id", "n_chunks", "n_tokens", "ids_crc32", (F.col("text_crc") == F.col("_crc")).alias("decoded"), "ids")
    return done.union(big)


def _text_crcs(rows: DataFrame, chunk: int) -> DataFrame:
    """(row, crc32 of a space and the text) from the stored chunks."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for k, at, part in zip(*(batch.column(c).to_pylist() for c in ("k", "at", "part")), strict=True):
                data = (" " * (k == 0) + part[k * chunk - at :][:chunk]).encode()
                got.append((zlib.crc32(data), len(data)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["row", "k", "crc", "size"])

    def joined(key, rows):
        rows = rows.sort_by("k").to_pydict()
        crc = 0
        for c, size in zip(rows["crc"], rows["size"], strict=True):
            crc = crc_joined(crc, c, size)
        return pa.table({"row": rows["row"][:1], "_crc": [crc]})

    return rows.select("row", "k", "at", "part").mapInArrow(own, "row long, k int, crc long, size long").groupBy("row").applyInArrow(joined, "row long, _crc long")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of lists of ids; null for null."""
    path = model or default_model()
    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if ids is None else vocab.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")


def op1_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op1_max_plus_pieces": op1_max_plus_pieces}
ORACLE: dict[str, str] = {}
