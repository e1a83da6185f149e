"""The prefix dynamic program over many pre-tokens at once, on arrays.

All pre-tokens of a group advance byte by byte together. At each byte the
token that ends there is the one, of all lengths, that is in the vocabulary and
may follow the last token of the prefix before it.
"""

from __future__ import annotations

import numpy as np

#: Two odd multipliers: a substring is looked up by both of its polynomial hashes, 128 bits.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SLOT_BITS = 20
#: Longest pre-token in bytes that is counted in groups; longer ones are rare.
LONGEST = 48
#: Pre-tokens of a group at most.
GROUP = 1 << 15


class Table:
    """A fixed map from 64-bit keys to small numbers, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = self._mix(keys)
        order = np.argsort(mixed, kind="stable")
        self.mixed, self.values = mixed[order], values[order]
        slots = (self.mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange(1 << SLOT_BITS)).astype(np.int32)
        self.chain = int(np.bincount(slots, minlength=1).max(initial=1))
        # A key that is nowhere ends every chain.
        self.mixed, self.values = np.append(self.mixed, np.zeros(self.chain + 1, np.uint64)), np.append(self.values, np.full(self.chain + 1, -1, values.dtype))

    @staticmethod
    def _mix(keys: np.ndarray) -> np.ndarray:
        """A one-to-one mixing of 64 bits."""
        k = keys ^ (keys >> np.uint64(32))
        k = k * BASES[0]
        return k ^ (k >> np.uint64(29))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for unknown ones."""
        mixed = self._mix(keys)
        at = self.first[(mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        out = np.where(self.mixed[at] == mixed, self.values[at], -1)
        for k in range(1, self.chain):
            missing = np.flatnonzero(out < 0)
            place = at[missing] + k
            hit = self.mixed[place] == mixed[missing]
            out[missing[hit]] = self.values[place[hit]]
        return out


def _hash(token: bytes, base: np.uint64) -> int:
    h, b = 0, int(base)
    for x in token:
        h = (h * b + x + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class BatchPrefixes:
    """Prefix counts of many pre-tokens; ``vocab`` are the tokens that encode to themselves, with their numbers."""

    def __init__(self, vocab: dict[bytes, int], rank: list[int], left: list[int], right: list[int], pair: dict[tuple[int, int], int]):
        tokens = [(t, n) for t, n in vocab.items() if len(t) <= LONGEST]
        numbers = np.array([n for _, n in tokens], np.int32)
        self.tokens = Table(np.array([_hash(t, BASES[0]) for t, _ in tokens], np.uint64), numbers)
        self.second = np.zeros(max(vocab.values()) + 1, np.uint64)
        self.second[numbers] = [_hash(t, BASES[1]) for t, _ in tokens]
        self.lengths = sorted({len(t) for t, _ in tokens}, reverse=True)
        self.rank, self.left, self.right = (np.array(x, np.int32) for x in (rank, left, right))
        self.pairs = Table(np.array([(a << 32) | b for a, b in pair], np.uint64), np.array(list(pair.values()), np.int32))
        self.limit = len(pair)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge spans the seam of two tokens: the later made of both is taken apart, again and again."""
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), self.limit, np.int32)
        while len(live):
            m = self.pairs.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            merged = (m >= 0) & (m < limit)
            ok[live[merged]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~merged & ((ra > rb) | (rb >= 0))
            live, a, b, limit, ra, rb = live[go], a[go], b[go], limit[go], ra[go], rb[go]
            first = ra > rb
            limit = np.minimum(limit, np.where(first, ra, rb + 1))
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """A row for each pre-token: the number of tokens of its first 0, 1, 2, ... bytes; beyond its end the rest is 0."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        hashes, powers = [], []
        for base in BASES:
            h = np.zeros((width + 1, len(pieces)), np.uint64)
            for e in range(width):
                h[e + 1] = h[e] * base + text[:, e] + np.uint64(1)
            hashes.append(h)
            powers.append(np.array([pow(int(base), e, 1 << 64) for e in range(width + 1)], np.uint64))
        last, count = np.full((width + 1, len(pieces)), -1, np.int32), np.zeros((width + 1, len(pieces)), np.int32)
        for end in range(1, width + 1):
            open_rows = np.flatnonzero(sizes >= end)
            for length in self.lengths:
                if length > end or not len(open_rows):
                    continue
                start = end - length
                token = self.tokens.get(hashes[0][end, open_rows] - hashes[0][start, open_rows] * powers[0][length])
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                rows, found = open_rows[hit], token[hit]
                sure = self.second[found] == hashes[1][end, rows] - hashes[1][start, rows] * powers[1][length]
                if start:
                    sure[sure] = self._may_follow(last[start, rows[sure]], found[sure])
                rows, found = rows[sure], found[sure]
                last[end, rows], count[end, rows] = found, count[start, rows] + 1
                keep = np.ones(len(open_rows), bool)
                keep[hit[sure]] = False
                open_rows = open_rows[keep]
            if len(open_rows):
                raise ValueError(f"no token ends at byte {end} of {pieces[open_rows[0]]!r}")
        return count.T

    def groups(self, pieces: list[bytes]):
        """(pre-tokens, their counts) in groups of like lengths."""
        pieces = sorted(pieces, key=len)
        at = 0
        while at < len(pieces):
            stop = at
            most = len(pieces[at]) + 3
            while stop < len(pieces) and stop - at < GROUP and len(pieces[stop]) <= most:
                stop += 1
            yield pieces[at:stop], self.counts(pieces[at:stop])
            at = stop
