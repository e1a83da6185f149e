"""Substring dedup by recompression.

Texts are sequences of symbols that shrink in rounds. The letters are words,
as 32-bit hashes. The first round names runs of equal letters and pairs of
neighbours (one of the left, one of the right half of the alphabet), each
further one pairs of what came out. Every round is a Spark job: chunks of
texts post the distinct runs and pairs they hold, dealt into parts by a 64-bit
key; each part numbers the keys that at least two rows hold, and the numbers go
back to the chunks. A number stands for one run or pair everywhere, so equal
substrings get equal symbols inside. What only one row holds needs no number:
it is part of no repeat, and the windows of words around it are given up at
once. Symbols that no window left contains are not posted again.

Each symbol carries the stretch of words that its forming depended on. Two
equal windows hold the same symbols wherever a symbol's stretch lies inside
them, so a window stays in the running as long as all such symbols, of every
level, are shared. Letters and keys that clash by chance only leave more
windows in it. Texts whose windows are all left and whose symbols are the same
are whole copies, confirmed by a digest; the windows left in other texts are
compared by 128 bits made of their words, as SQL compares them by md5.

A chunk, with its distinct words and their places, is one row, and so is what it
posts to a part: Spark deals few rows, and a task holds a chunk or a part at a
time, whose sizes do not grow with the input.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import discard, id_key, materialise, spread_join
from tally.llm.word_hashes import STEP_1, STEP_2, mix, prefix_hashes, range_hashes

ROUNDS = 3
#: Words of a chunk, about, and texts at most; a longer text is a chunk of its own.
CHUNK_WORDS, CHUNK_TEXTS = 400_000, 100_000
#: Words of all texts for each part, about.
PART_WORDS = 1_000_000
#: Longer runs are cut into pieces of this many words, and no symbol of more than twice as many is formed.
LONGEST = 120
#: Bits of a text's place in its row number; bits below the round and the part in the number of a run or pair.
ROW_BITS, ROUND_BITS, PART_BITS = 23, 56, 32
#: Arrays are kept in byte planes: all first bytes, all second bytes and so on. Those of chunks and symbols are compressed.
#: A chunk: its distinct words, the places of all words in them, the words and the id of each text; and a row for each text.
FIRST = "chunk long, words binary, at binary, lens binary, ids binary, row long, own_id long, id long, n_words long, sha string"
CHUNK = ["chunk", "words", "at", "lens", "ids"]
#: A chunk's symbols: ``alive`` has a bit for each start of a window. ``name`` is a number (-1 without one,
#: -2 - k while key k waits for it), ``size`` its words, ``before`` and ``after`` how far the stretch reaches
#: beyond these, up to 255. Keys are sorted; ``many`` is set if several texts of the chunk hold one.
STATE = "chunk long, texts binary, lens binary, name binary, size binary, before binary, after binary, alive binary, cut binary, keys binary, many binary"
SYMBOLS = ["texts", "lens", "name", "size", "before", "after", "alive"]
#: What a chunk posts to a part, sorted by key, and what comes back, in that order.
POST = "part long, chunk long, key binary, more binary, lo binary, hi binary"
ANSWER = "chunk long, part long, which binary, value binary"
#: Part numbers of rows that tell a chunk which windows are left, and which of its texts are whole copies.
LEFT, TWINS = -1, -2
LAST = f"{ANSWER}, row long, content binary"
CHANGED = "row long, n_removed long, sha string, kept_text string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def _record(values: dict, ddl: str) -> pa.RecordBatch:
    n, schema = len(next(iter(values.values()))), _arrow(ddl)
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _packed(values: dict) -> dict:
    """The columns of a row, compressed behind their length; what is shuffled is then as small as what is written."""
    return {k: [len(v).to_bytes(8, "little") + pa.compress(v, "zstd", asbytes=True)] for k, v in values.items()}


def _unpacked(row: dict, columns: list[str]) -> dict:
    return row | {k: pa.decompress(row[k][8:], int.from_bytes(row[k][:8], "little"), "zstd", asbytes=True) for k in columns}


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _ends(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _cut(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the sorted keys begins, and their end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(np.uint64)).astype(np.int64)


@dataclass
class Symbols:
    """The symbols of a chunk's texts; words are counted over all these texts."""

    name: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    own: np.ndarray
    start: np.ndarray
    alive: np.ndarray
    texts: np.ndarray
    lens: np.ndarray


def pairs(name: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, size: np.ndarray, turn: int):
    """(all symbols that stay or begin a pair, whether they begin one, low, high) of a round.

    Only symbols that ``may`` join do. What stays alone depends on its
    neighbour on the side where it might have joined; at the ends of a text it
    depends on what lies beyond, so that no window contains it.
    """
    n = len(name)
    right = (mix(name.astype(np.uint64) ^ np.uint64(turn * STEP_1 % 2**64)) >> np.uint64(63)).astype(bool)
    next_same = own[1:] == own[:-1]
    joins = np.zeros(n, bool)
    joins[:-1] = ~right[:-1] & right[1:] & next_same & may[:-1] & may[1:] & (size[:-1] + size[1:] <= 2 * LONGEST)
    joined = np.zeros(n, bool)
    joined[1:] = joins[:-1]
    left_low = np.concatenate([low[:1] - 1, np.where(next_same, low[:-1], low[1:] - 1)])
    right_high = np.concatenate([np.where(next_same, high[1:], high[:-1] + 1), high[-1:] + 1])
    low_alone = np.where(right, np.minimum(left_low, low), low)
    high_alone = np.where(right, high, np.maximum(right_high, high))
    at = np.flatnonzero(~joined)
    pair = joins[at]
    mate = np.minimum(at + 1, n - 1)
    return at, pair, np.where(pair, low[at], low_alone[at]), np.where(pair, high[mate], high_alone[at])


def _inside(alive: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Whether a window that is left contains [low, high)."""
    left = _ends(alive)
    begin, end = np.clip(high - width, 0, len(alive)), np.clip(low + 1, 0, len(alive))
    return (begin < end) & (left[end] > left[np.minimum(begin, end)])


def _round(s: Symbols, single: np.ndarray, width: int, turn: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """(symbols after a round, its sorted keys, whether several texts hold them); what is not ``single`` is a run."""
    at, pair, low, high = pairs(s.name, (s.name >= 0) & single, s.low, s.high, s.own, s.size, turn)
    formed = pair | ~single[at]
    new, size, own = s.name[at], s.size[at], s.own[at]
    new[formed] = -1
    post = np.flatnonzero(formed & _inside(s.alive, low, high, width))
    first = at[post]
    partner = np.where(pair[post], s.name[np.minimum(first + 1, len(s.name) - 1)], -s.size[first])
    key = mix((s.name[first].astype(np.uint64) * np.uint64(STEP_1)) ^ mix(partner.astype(np.uint64) + np.uint64(STEP_2)))
    keys, which = np.unique(key, return_inverse=True)
    new[post] = -2 - which
    lo, hi = np.full(len(keys), len(s.lens), np.int64), np.full(len(keys), -1, np.int64)
    np.minimum.at(lo, which, own[post])
    np.maximum.at(hi, which, own[post])
    size[pair] += s.size[at[pair] + 1]
    return Symbols(new, size, low, high, own, s.start[at], s.alive, s.texts, s.lens), keys, lo < hi


def _letters(of: np.ndarray, lens: np.ndarray, width: int) -> tuple[Symbols, np.ndarray]:
    """(letters and runs of letters, whether they are letters) of the texts."""
    text, n = np.repeat(np.arange(len(lens)), lens), len(of)
    new = np.ones(n, bool)
    new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)[: len(start)]
    # The pieces of a long run; each depends on where the run begins and ends.
    times = -(-(end - start) // LONGEST)
    low, high = np.repeat(start - 1, times), np.repeat(end + 1, times)
    piece = np.arange(len(low)) - np.repeat(np.cumsum(times) - times, times)
    start = np.repeat(start, times) + piece * LONGEST
    size = np.minimum(high - 1 - start, LONGEST)
    alive = np.arange(n) <= np.repeat(np.cumsum(lens) - width, lens)
    return Symbols(of[start], size, low, high, text[start], start, alive, np.arange(len(lens)), lens), size == 1


def _settled(s: Symbols, given: np.ndarray, width: int) -> Symbols:
    """The symbols with the numbers of a round, without texts that have no window left."""
    name = np.where(s.name <= -2, given[np.maximum(-2 - s.name, 0)], s.name) if len(given) else s.name
    words = len(s.alive)
    lone = np.flatnonzero((name == -1) & (s.high - s.low <= width))
    gone = np.zeros(words + 2, np.int64)
    np.add.at(gone, np.clip(s.high[lone] - width, 0, words), 1)
    np.add.at(gone, np.clip(s.low[lone] + 1, 0, words + 1), -1)
    alive = s.alive & (np.cumsum(gone)[:words] == 0)
    of_word = np.repeat(np.arange(len(s.lens)), s.lens)
    keep = np.bincount(of_word[alive], minlength=len(s.lens)) > 0
    name = np.where(_inside(alive, s.low, s.high, width), name, -1)
    stay = keep[s.own]
    lost = np.cumsum(np.where(keep, 0, s.lens))[s.own[stay]]
    own = (np.cumsum(keep) - 1)[s.own[stay]]
    return Symbols(name[stay], s.size[stay], s.low[stay] - lost, s.high[stay] - lost, own, s.start[stay] - lost, alive[keep[of_word]], s.texts[keep], s.lens[keep])


class Words(dict):
    """word -> place among the distinct words."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[list[bytes]]]]:
    """(own ids, ids, words) of groups of texts with about CHUNK_WORDS words."""
    some, n = ([], [], []), 0
    for b in batches:
        for own, id_, t in zip(*(b.column(k) for k in range(3))):
            words = (t.as_py() or "").encode().split()
            if some[0] and (n + len(words) > CHUNK_WORDS or len(some[0]) == CHUNK_TEXTS):
                yield some
                some, n = ([], [], []), 0
            for kept, value in zip(some, (own.as_py(), id_.as_py(), words)):
                kept.append(value)
            n += len(words)
    if some[0]:
        yield some


def _chunks(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for nth, (own_ids, ids, texts) in enumerate(_texts(batches)):
            chunk, words, at = (task << 20) + nth, Words(), array("I")
            for t in texts:
                at.extend(map(words.__getitem__, t))
            lens = [len(t) for t in texts]
            rows = (chunk << ROW_BITS) + np.arange(len(texts), dtype=np.int64)
            yield _record({"row": rows, "own_id": own_ids, "id": ids, "n_words": lens, "sha": [hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]}, FIRST)
            whole = {"words": b"\n".join(words), "at": _planes(np.array(at, np.uint32)), "lens": _planes(np.array(lens, np.uint32)), "ids": _planes(np.array(ids, np.int64))}
            yield _record({"chunk": [chunk], **_packed(whole)}, FIRST)

    return docs.mapInArrow(run, FIRST)


def _first_round(row: dict, width: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    row = _unpacked(row, ["words", "at", "lens"])
    letters = np.array([xxhash.xxh32_intdigest(w) for w in row["words"].split()], np.int64)
    return _round(*_letters(letters[_values(row["at"], np.uint32)], _values(row["lens"], np.uint32).astype(np.int64), width), width, 1)


def _read(row: dict) -> Symbols:
    row = _unpacked(row, SYMBOLS)
    lens = _values(row["lens"], np.uint32).astype(np.int64)
    size, before, after = (np.frombuffer(row[c], np.uint8).astype(np.int64) for c in ("size", "before", "after"))
    start = np.cumsum(size) - size
    own = np.searchsorted(np.cumsum(lens), start, side="right")
    return Symbols(_values(row["name"], np.int64), size, start - before, start + size + after, own, start, _bits(row["alive"], int(lens.sum())), _values(row["texts"], np.uint32).astype(np.int64), lens)


def _written(chunk: int, s: Symbols, keys: np.ndarray, many: np.ndarray, parts: int) -> pa.RecordBatch:
    far = lambda x: np.minimum(x, 255).astype(np.uint8).tobytes()
    symbols = {
        "texts": _planes(s.texts.astype(np.uint32)), "lens": _planes(s.lens.astype(np.uint32)), "name": _planes(s.name), "size": s.size.astype(np.uint8).tobytes(),
        "before": far(s.start - s.low), "after": far(s.high - s.start - s.size), "alive": np.packbits(s.alive).tobytes(),
    }
    return _record({"chunk": [chunk], **_packed(symbols), "cut": [_planes(_cut(keys, parts))], "keys": [_planes(keys)], "many": [np.packbits(many).tobytes()]}, STATE)


def _posts(chunk: int, cut: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part that gets something; flags are packed, other values go in planes."""
    to = np.flatnonzero(cut[1:] > cut[:-1])
    pack = lambda x: np.packbits(x).tobytes() if x.dtype == bool else _planes(x)
    return _record({"part": to, "chunk": [chunk] * len(to), **{k: [pack(x[cut[p] : cut[p + 1]]) for p in to.tolist()] for k, x in columns.items()}}, POST)


def _names(table: DataFrame, width: int, turn: int, parts: int) -> DataFrame:
    """The written table of numbers for a round's keys that at least two rows hold; a chunk posts a key once."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                if turn == 1:
                    _, keys, many = _first_round(row, width)
                else:
                    keys = _values(row["keys"], np.uint64)
                    many = _bits(row["many"], len(keys))
                yield _posts(row["chunk"], _cut(keys, parts), key=keys, more=many)

    def number(posts: pa.Table) -> pa.Table:
        keys = [_values(x, np.uint64) for x in posts.column("key").to_pylist()]
        cut = _ends([len(x) for x in keys])
        many = np.concatenate([_bits(x, len(y)) for x, y in zip(posts.column("more").to_pylist(), keys)])
        some, which, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = (n > 1) | (np.bincount(which, many, len(some)) > 0)
        rank, held = (np.cumsum(shared) - 1).astype(np.uint32)[which], shared[which]
        at = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.Table.from_batches([_record({"chunk": posts.column("chunk").to_numpy(), "part": posts.column("part").to_numpy(), "which": [np.packbits(held[a:b]).tobytes() for a, b in at], "value": [_planes(rank[a:b][held[a:b]]) for a, b in at]}, ANSWER)])

    columns = ["chunk", "words", "at", "lens"] if turn == 1 else ["chunk", "keys", "many"]
    return materialise(table.select(*columns).mapInArrow(post, POST).groupBy("part").applyInArrow(number, ANSWER), "substring-named")


def _answers(answers: pa.Table, cut: np.ndarray, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, places among all posts, values) of what came back to a chunk."""
    for part, which, value in zip(*(answers.column(c).to_pylist() for c in ("part", "which", "value"))):
        if part >= 0:
            yield part, cut[part] + np.flatnonzero(_bits(which, int(cut[part + 1] - cut[part]))), _values(value, kind)


def _next_round(table: DataFrame, named: DataFrame, width: int, turn: int, parts: int) -> DataFrame:
    """The chunks after the numbers of the last round were put in and another round of pairs.

    After the last round: the windows left in each chunk, and for its texts
    ``content``, which stands for their symbols if all windows are left.
    """
    ddl = STATE if turn <= ROUNDS else LAST

    def run(chunks: pa.Table, names: pa.Table) -> pa.Table:
        for row in chunks.to_pylist():
            if turn == 2:
                s, keys, _ = _first_round(row, width)
                cut = _cut(keys, parts)
            else:
                s, cut = _read(row), _values(row["cut"], np.int64)
            given = np.full(int(cut[-1]), -1, np.int64)
            for part, at, rank in _answers(names, cut, np.uint32):
                given[at] = ((turn - 1) << ROUND_BITS) + (part << PART_BITS) + rank.astype(np.int64)
            s = _settled(s, given, width)
            if len(s.lens) == 0:
                break
            if turn <= ROUNDS:
                return pa.Table.from_batches([_written(row["chunk"], *_round(s, np.ones(len(s.name), bool), width, turn), parts)])
            cut = np.searchsorted(s.own, np.arange(len(s.lens) + 1))
            whole = np.bincount(np.repeat(np.arange(len(s.lens)), s.lens)[s.alive], minlength=len(s.lens)) == s.lens - width + 1
            content = [xxhash.xxh3_128_digest(s.name[cut[k] : cut[k + 1]].tobytes()) for k in np.flatnonzero(whole).tolist()]
            left = _record({"chunk": [row["chunk"]], "part": [LEFT], "which": [np.packbits(s.alive).tobytes()], "value": [_planes(s.texts.astype(np.uint32))]}, LAST)
            return pa.Table.from_batches([left, _record({"row": (row["chunk"] << ROW_BITS) + s.texts[whole], "content": content}, LAST)])
        return _arrow(ddl).empty_table()

    return table.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(run, ddl)


class Left:
    """The windows left in a chunk: their starts and texts, the distinct ones by 128 bits, and which of these each is."""

    def __init__(self, row: dict, marks: pa.Table, width: int, parts: int):
        row = _unpacked(row, CHUNK[1:])
        self.words = row["words"].split()
        self.at, self.lens, self.ids = _values(row["at"], np.uint32), _values(row["lens"], np.uint32).astype(np.int64), _values(row["ids"], np.int64)
        self.begin, own = _ends(self.lens), np.repeat(np.arange(len(self.lens)), self.lens)
        alive, twins = np.zeros(len(self.at), bool), np.zeros(len(self.lens), bool)
        for part, which, texts, rows in zip(*(marks.column(c).to_pylist() for c in ("part", "which", "value", "rows"))):
            if part == LEFT:
                some = np.zeros(len(self.lens), bool)
                some[_values(texts, np.uint32)] = True
                alive[some[own]] = _bits(which, int(self.lens[some].sum()))
            elif part == TWINS:
                twins[np.array(rows, np.int64) & ((1 << ROW_BITS) - 1)] = True
        self.start = np.flatnonzero(alive & ~twins[own])
        self.own = own[self.start]
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in self.words]), np.uint64).reshape(-1, 2)
        a, b = (range_hashes(*prefix_hashes(hashes[:, k][self.at], step), self.start, self.start + width) for k, step in enumerate((STEP_1, STEP_2)))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.which = np.empty(len(a), np.int64)
        self.which[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.a, self.b, ids = a[first], b[first], self.ids[self.own][order]
        self.lo, self.hi = (f.reduceat(ids, first) if len(ids) else ids for f in (np.minimum, np.maximum))
        self.cut = _cut(self.a, parts)


def _earlier(chunks: DataFrame, marks: DataFrame, width: int, parts: int) -> DataFrame:
    """The smallest id with a window, for each chunk that has it under a larger id too."""

    def post(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        for row in chunk.to_pylist() if marks.num_rows else []:
            w = Left(row, marks, width, parts)
            return pa.Table.from_batches([_posts(row["chunk"], w.cut, key=w.a, more=w.b, lo=w.lo, hi=w.hi)])
        return _arrow(POST).empty_table()

    def least(posts: pa.Table) -> pa.Table:
        columns = [[_values(x, kind) for x in posts.column(c).to_pylist()] for c, kind in (("key", np.uint64), ("more", np.uint64), ("lo", np.int64), ("hi", np.int64))]
        cut = _ends([len(x) for x in columns[0]])
        a, b, lo, hi = (np.concatenate(x) for x in columns)
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        least = np.empty(len(a), np.int64)
        least[order] = np.minimum.reduceat(lo[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = hi > least
        at = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.Table.from_batches([_record({"chunk": posts.column("chunk").to_numpy(), "part": posts.column("part").to_numpy(), "which": [np.packbits(later[i:j]).tobytes() for i, j in at], "value": [_planes(least[i:j][later[i:j]]) for i, j in at]}, ANSWER)])

    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(post, POST).groupBy("part").applyInArrow(least, ANSWER)


def _removed(chunks: DataFrame, marks: DataFrame, width: int, parts: int, with_text: bool) -> DataFrame:
    """(row, n_removed, sha, kept_text) of the texts that lose words to windows of earlier texts."""

    def run(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        out = {"row": [], "n_removed": [], "sha": [], "kept_text": []}
        for row in chunk.to_pylist() if marks.num_rows else []:
            w = Left(row, marks, width, parts)
            earlier, least = np.zeros(len(w.a), bool), np.zeros(len(w.a), np.int64)
            for _, at, value in _answers(marks, w.cut, np.int64):
                earlier[at], least[at] = True, value
            gone_at = earlier[w.which] & (w.ids[w.own] > least[w.which])
            edge = np.zeros(len(w.at) + 1, np.int64)
            np.add.at(edge, w.start[gone_at], 1)
            np.add.at(edge, w.start[gone_at] + width, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for k in np.unique(w.own[gone_at]).tolist():
                lost = gone[w.begin[k] : w.begin[k + 1]]
                rest = b" ".join([w.words[x] for x in w.at[w.begin[k] : w.begin[k + 1]][~lost].tolist()])
                for c, value in zip(out.values(), ((row["chunk"] << ROW_BITS) + k, int(lost.sum()), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None)):
                    c.append(value)
        return pa.Table.from_batches([_record(out, CHANGED)])

    return chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, CHANGED)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): each text without the words of repeated windows.

    A word goes if a window of ``width`` words (up to 240) that covers it also
    starts in a document with a smaller id; windows are judged on the input.
    Words are split at ASCII white space; kept words are joined by one space.
    Null or short texts lose nothing. A null id is smaller than all others;
    rows of one id do not remove from each other, repeated rows are treated
    alike. A very long text is handled whole, in memory in proportion to its
    words; an empty table gives an empty result; other columns are not read.
    Of texts of the same words only the first posts its windows: all windows
    of the others start there.
    ``kept_text`` is null where nothing was removed.
    """
    if not 1 <= width <= 2 * LONGEST:
        raise ValueError(f"width must be 1 to {2 * LONGEST}")
    d = docs.select(F.col(id_col).cast("long").alias("own_id"), id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    table = materialise(_chunks(d), "substring-chunks")
    seen = materialise(table.where("row is not null").select("row", "own_id", "id", "n_words", "sha"), "substring-texts")
    chunks = table.where("chunk is not null").select(*CHUNK)
    parts = 1 + (seen.agg(F.sum("n_words")).first()[0] or 0) // PART_WORDS
    state = chunks
    for turn in range(2, ROUNDS + 2):
        named = _names(state, width, turn - 1, parts)
        after = materialise(_next_round(state.drop("keys", "many", "ids"), named, width, turn, parts), "substring-round")
        discard(named)
        if turn > 2:
            discard(state)
        state = after

    # Whole texts that an earlier document has symbol for symbol, and word for word.
    whole = state.where("row is not null").select("row", "content").join(seen.select("row", "id", "sha"), "row")
    whole = materialise(whole, "substring-whole")
    same = whole.groupBy("content", "sha").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")).where("first < last").select("content", "sha", "first", "size")
    same = materialise(same, "substring-groups")
    twins = materialise(spread_join(whole, same, ["content", "sha"], "size").where("id > first").select("row"), "substring-twins")
    discard(same)
    discard(whole)
    copies = twins.groupBy(F.shiftright("row", ROW_BITS).alias("chunk")).agg(F.collect_list("row").alias("rows")).withColumn("part", F.lit(TWINS).cast("long"))
    marks = state.where("chunk is not null").select("chunk", "part", "which", "value").unionByName(copies, allowMissingColumns=True)
    earlier = materialise(_earlier(chunks, marks, width, parts), "substring-earlier")
    changed = materialise(_removed(chunks, marks.unionByName(earlier, allowMissingColumns=True), width, parts, with_text), "substring-changed")
    for t in (table, state, earlier):
        discard(t)

    empty = hashlib.sha256(b"").hexdigest()
    changed = changed.withColumnRenamed("sha", "kept_sha")
    out = seen.join(twins.withColumn("twin", F.lit(True)), "row", "left").join(changed, "row", "left")
    cols = [
        F.col("own_id").alias(id_col),
        "n_words",
        F.when(F.col("twin"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("twin"), F.lit(empty)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        cols.append(F.when(F.col("twin"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*cols)
