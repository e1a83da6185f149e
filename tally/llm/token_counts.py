"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair encoding the last token of the encoding of a prefix is the only
token that ends there and may follow the last token of the prefix before it.
So one pass over the bytes gives the count at every prefix; truncation and
budget questions are then answered from the stored counts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.prefix_batches import LONGEST, BatchPrefixes
from tally.llm.word_chunks import PIECES, PLAIN, WORD, PartCache, byte_characters

_loaded: dict = {}
#: Bytes at the end of a string by which the tokens it may end with are looked up.
END_BYTES = 5
#: Beginnings of pre-tokens that are kept have so many bytes at most.
KEPT_BYTES = 24
#: Texts whose words are looked over at once.
PREPARED = 2_000
#: The stored form of a change of the count.
STEP = np.dtype(np.int16)
#: The characters with Unicode's White_Space property.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class EndLengths(dict):
    """Up to END_BYTES bytes -> the lengths, longest first, of the tokens that a string ending in them may end with."""

    def __init__(self, vocab: Iterable[bytes]):
        super().__init__()
        self.vocab = vocab
        self.long: dict[bytes, set[int]] = {}
        for token in vocab:
            if len(token) >= END_BYTES:
                self.long.setdefault(token[-END_BYTES:], set()).add(len(token))

    def __missing__(self, end: bytes) -> tuple[int, ...]:
        short = {n for n in range(1, END_BYTES) if n <= len(end) and end[-n:] in self.vocab}
        found = self[end] = tuple(sorted(short | self.long.get(end, set()), reverse=True))
        return found


class PrefixCounter:
    """Prefix counts for one byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        # Where several special strings start at one place, the longest counts.
        special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = {c: b for b, c in enumerate(byte_characters())}
        raw = {t: bytes(shown[c] for c in t) for t in model["vocab"] if all(c in shown for c in t)}
        self.vocab = {b: n for n, b in enumerate(raw.values())}
        # For each token the merge that makes it: its rank and its two halves. Single bytes have rank -1.
        self.rank, self.left, self.right, self.pair = [-1] * len(raw), [0] * len(raw), [0] * len(raw), {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (raw[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            i, j, made = self.vocab[a], self.vocab[b], self.vocab.get(a + b)
            self.pair.setdefault((i, j), rank)
            if made is not None and self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, i, j
        self.vocab = {b: n for b, n in self.vocab.items() if len(b) == 1 or self.rank[n] >= 0 and self._joins(b, n)}
        self.lengths = EndLengths(self.vocab)
        self.follows: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[bytes, tuple[list[int], list[int]]] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.steps: dict[str, bytes] = {}
        self.cache = PartCache(self.part)
        self.batches = BatchPrefixes(self.vocab, self.rank, self.left, self.right, self.pair)

    def prepare(self, texts: list[str | None]) -> None:
        """Counts the pre-tokens of the words of many texts at once, so that the texts find them known."""
        words: set[str] = set()
        for t in texts:
            if t and not self.special.search(t):
                words.update(t.split(" "))
        cache, steps, pieces = self.cache, self.steps, self.pieces
        cache.make_room()
        if len(steps) > 200_000:
            steps.clear()
        if len(pieces) > 100_000:
            pieces.clear()
        known, aside = cache.keys(), cache.aside.keys()
        parts = [w for w in map(" ".__add__, words) if w not in known and w not in aside and len(w) <= LONGEST]
        # Words without anything that needs care are done here; of others only the pre-tokens are.
        whole = [(w, PIECES(w)) for w in parts if WORD(w)]
        others = [PIECES(w) for w in parts if not WORD(w) and PLAIN(w)]
        new = {p for _, ps in whole for p in ps}
        new.update(*others)
        new.difference_update(steps)
        by_bytes = {p.encode(): p for p in new}
        for group, counts in self.batches.groups([b for b in by_bytes if len(b) <= LONGEST]):
            changes = np.diff(counts, axis=1).astype(STEP)
            row = changes.shape[1] * STEP.itemsize
            raw = changes.tobytes()
            at = 0
            for b in group:
                steps[by_bytes[b]] = raw[at : at + len(b) * STEP.itemsize]
                at += row
        for w, ps in whole:
            cache[w] = self._steps(ps[0]) if len(ps) == 1 else b"".join([self._steps(p) for p in ps])
        for ps in others:
            for p in ps:
                b = p.encode()
                if b not in pieces and p in steps:
                    pieces[b] = np.cumsum(np.frombuffer(steps[p], STEP)).tolist()

    def _joins(self, token: bytes, n: int) -> bool:
        """True if the token's own bytes encode to it: its halves may stand side by side until its merge."""
        return self._apart(self.left[n], self.right[n], self.rank[n])

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """True if no merge of rank below ``limit`` spans the seam between two tokens.

        Goes back in time: the later made of the two tokens is taken apart,
        and the pair then at the seam must not have merged before that.
        Merges of one rank happen from left to right.
        """
        rank, pair = self.rank, self.pair
        while True:
            m = pair.get((a, b))
            if m is not None and m < limit:
                return False
            if rank[a] > rank[b]:
                limit = min(limit, rank[a])
                a = self.right[a]
            elif rank[b] >= 0:
                limit = min(limit, rank[b] + 1)
                b = self.left[b]
            else:
                return True

    def _may_follow(self, a: int, b: int) -> bool:
        ok = self.follows.get((a, b))
        if ok is None:
            if len(self.follows) > 300_000:
                self.follows.clear()
            ok = self.follows[a, b] = self._apart(a, b, len(self.pair))
        return ok

    def piece(self, s: bytes) -> list[int]:
        """Counts after 1, 2, ... bytes of one pre-token."""
        known = self.pieces.get(s)
        if known is not None:
            return known
        get, lengths, follows, may, prefixes = self.vocab.get, self.lengths, self.follows.get, self._may_follow, self.prefixes
        # Pre-tokens share beginnings: go on from the longest one that is kept.
        kept, last, count = 0, [-1], [0]
        for end in range(min(len(s) - 1, KEPT_BYTES), 0, -1):
            found = prefixes.get(s[:end])
            if found is not None:
                kept, last, count = end, found[0][: end + 1], found[1][: end + 1]
                break
        for end in range(kept + 1, len(s) + 1):
            for length in lengths[s[end - END_BYTES : end] if end > END_BYTES else s[:end]]:
                start = end - length
                token = get(s[start:end]) if start >= 0 else None
                if token is None:
                    continue
                if start:
                    ok = follows((last[start], token))
                    if ok is None:
                        ok = may(last[start], token)
                    if not ok:
                        continue
                last.append(token)
                count.append(count[start] + 1)
                break
            else:
                raise ValueError(f"no token ends at byte {end} of {s[:80]!r}")
        if len(prefixes) > 200_000:
            prefixes.clear()
        if len(s) <= 4 * KEPT_BYTES:
            found = last, count
            for end in range(kept + 1, min(len(s), KEPT_BYTES) + 1):
                prefixes[s[:end]] = found
        if len(self.pieces) > 100_000:
            self.pieces.clear()
        known = self.pieces[s] = count[1:]
        return known

    def _steps(self, piece: str) -> bytes:
        known = self.steps.get(piece)
        if known is None:
            if len(self.steps) > 200_000:
                self.steps.clear()
            known = self.steps[piece] = _changes(self.piece(piece.encode()))
        return known

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text: by a plain pattern where that is sure to agree, else by the library."""
        if PLAIN(text):
            return PIECES(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> list[int]:
        """Counts after each byte of a text without special strings, as if the text ended there.

        Only character boundaries have a meaning. Where a prefix splits
        otherwise than the whole does, its own split counts: a run of white
        space is one piece when nothing follows, and a cut contraction is an
        apostrophe and a letter.
        """
        out: list[int] = []
        base, run, run_base = 0, b"", 0
        for p in self.split(text):
            s = p.encode()
            counts = self.piece(s)
            if len(s) == 3 and p[0] == "'" and p[1:].isalpha():
                counts = [counts[0], counts[0] + self.piece(s[1:2])[0], counts[2]]
            counts = [base + c for c in counts]
            total = counts[-1]
            blank = WHITE.issuperset(p)
            if run and (blank or p[0] in WHITE):
                # A prefix that ends within this run of white space has the run as one piece.
                lead = s if blank else s[:1]
                whole = self.piece(run + lead)[len(run) :]
                counts[: len(whole)] = [run_base + c for c in whole]
            if blank:
                if not run:
                    run_base = base
                run += s
            else:
                run = b""
            out += counts
            base = total
        self.total = base
        return out

    def counts(self, text: str) -> list[int]:
        """Counts after each byte of a whole text."""
        out: list[int] = []
        at = base = 0
        for m in self.special.finditer(text):
            before = text[at : m.start()]
            head = self.plain(before)
            after = base + self.total + 1
            # Inside the special string a prefix is ordinary text; at its end it is one token.
            inside = self.plain(before + m[0][:-1])[len(head) :]
            out += [base + c for c in head]
            out += [base + c for c in inside]
            out.append(after)
            base, at = after, m.end()
        return out + [base + c for c in self.plain(text[at:])]

    def part(self, text: str) -> bytes:
        """The change of the count at each byte of a part between two cuts; they add up to its count."""
        if WORD(text) and not self.special.search(text):
            return b"".join([self._steps(p) for p in PIECES(text)])
        return _changes(self.counts(text))

    def document(self, text: str | None) -> tuple[bytes, int]:
        """(changes of the count at each byte, count) of a whole text; null counts as empty."""
        changes = self.cache.document(text or "")
        return changes, int(np.frombuffer(changes, STEP).sum(dtype=np.int64))


def _changes(counts: list[int]) -> bytes:
    """Differences of the counts, starting from 0. A byte changes the count by less than the
    bytes of the longest token, which 16 bits hold by far."""
    return array("h", map(sub, counts, [0, *counts])).tobytes() if counts else b""


def counter(file: str) -> PrefixCounter:
    if file not in _loaded:
        _loaded[file] = PrefixCounter(file)
    return _loaded[file]


def prefix_counts(changes: bytes) -> np.ndarray:
    """Token counts after 0, 1, 2, ... bytes from the stored changes."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(changes, STEP), dtype=np.int64)])


def tokens_at(changes: bytes, n_bytes: int) -> int:
    """Tokens of the prefix of ``n_bytes`` bytes (a character boundary)."""
    return int(prefix_counts(changes)[n_bytes])


def longest_within(changes: bytes, text: str, budget: int) -> int:
    """Bytes of the longest prefix, at a character boundary, of at most ``budget`` tokens."""
    raw = np.frombuffer(text.encode() + b"a", np.uint8)
    counts = prefix_counts(changes)
    ok = ((raw & 0xC0) != 0x80) & (counts <= budget)
    return int(np.flatnonzero(ok)[-1]) if ok.any() else 0


def token_counts(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, bytes_in_budget, prefix_changes) per row.

    ``prefix_changes`` holds for each UTF-8 byte the change of the token count
    when the text is cut behind it (see :func:`tokens_at` and
    :func:`longest_within`); ``bytes_in_budget`` is read off it: the bytes of
    the longest prefix of at most ``budget`` tokens. Null text counts as empty:
    no bytes, no tokens. Special strings in a text count as their special
    token. A very long text takes time and memory in proportion to its length.
    Rows are independent: a null or repeated id gives a row like any other,
    an empty table an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(file)
        for b in batches:
            texts = b.column(1).to_pylist()
            done = []
            for at in range(0, len(texts), PREPARED):
                count.prepare(texts[at : at + PREPARED])
                done += [count.document(t) for t in texts[at : at + PREPARED]]
            within = [len(c) // STEP.itemsize if n <= budget else longest_within(c, t, budget) for t, (c, n) in zip(texts, done)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x[0]) // STEP.itemsize for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
                    pa.array(within, pa.int64()), pa.array([x[0] for x in done], pa.large_binary()).cast(pa.binary()),
                ],
                names=["id", "n_bytes", "n_tokens", "bytes_in_budget", "prefix_changes"],
            )

    pair = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return pair.mapInArrow(run, "id long, n_bytes long, n_tokens long, bytes_in_budget long, prefix_changes binary").withColumnRenamed("id", id_col)
