"""Join of texts by the Jaccard similarity of their word n-grams, with signature trees.

Equal sets are one class. Classes that can be similar share one of the first
few shingles of a fixed order (prefix filter; long shingles come first, for
they are rare). Among the classes of such a block a tree is built: its nodes
hold the OR and the AND of their sets' token bitmaps and the range of set
sizes. A dual traversal drops pairs of nodes whose largest possible overlap is
too small; pairs of sets that remain are compared in full. Links found are
joined into components, and pairs of one component are not looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import NULL_ID, discard, id_key, keep_rows, materialise
from tally.llm.word_hashes import BATCH_WORDS, STEP_1, Words, prefix_hashes, range_hashes

#: Token bitmaps: (least length in 64-bit words, most shingles a bit); larger sets get longer ones.
#: The rough ones, sent with each posting, tell who may have a partner; the fine ones who it may be.
ROUGH, FINE = (4, 1.2), (16, 0.5)
#: Rows of three numbers up to which the table of documents with a partner is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
LEAF = 32
#: Shingles of one block that a task takes together, about; larger blocks are split.
BLOCK_SHINGLES = 8_000_000
#: Shared shingles by which a class is compared in full at first: more for the
#: short sets of up to SHORT shingles, which are cheap to send.
PROBES, SHORT = 3, 1000


def shingle_sets(words: Words, texts: list[list[bytes]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct hashes, their byte lengths) of each text's word k-grams; of a shorter text, the whole."""
    h, _, text = words.numbers(texts)
    size = np.fromiter((len(w) for t in texts for w in t), np.int64, len(h))
    total = np.concatenate([[0], np.cumsum(size)])
    sums, back = prefix_hashes(h, STEP_1)
    out, at = [], 0
    for t in texts:
        n = len(t)
        if n == 0:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        start = np.arange(at, at + max(1, n - k + 1))
        end = start + min(k, n)
        key, first = np.unique(range_hashes(sums, back, start, end), return_index=True)
        out.append((key, (total[end] - total[start])[first]))
        at += n
    return out


def prefix_of(key: np.ndarray, length: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the fixed order; similar sets share one of them."""
    n = len(key)
    p = n - (num * n + den - 1) // den + 1 if n else 0
    return key[np.lexsort((key, -length))[:p]]


def bitmap(key: np.ndarray, size: tuple[int, float] = FINE) -> np.ndarray:
    """A set's token bitmap: a power of two of bits, as many as the set's size and ``size`` ask for."""
    words, load = size
    while words * 64 * load < len(key):
        words *= 2
    bits = np.zeros(words * 64, np.uint8)
    bits[(key >> np.uint64(20)).astype(np.int64) % (words * 64)] = 1
    return np.packbits(bits).view(np.uint64)


def width_groups(n: np.ndarray, bits: list[bytes], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members in order of size, their bitmaps of one length) for each length of bitmap.

    Those of longer bitmaps that are small enough to be similar to a member
    of this length come along with theirs folded; so each pair that can be
    similar is together in a group.
    """
    words = np.fromiter((len(b) // 8 for b in bits), np.int64, len(bits))
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        at = np.concatenate([own, np.flatnonzero((words > w) & (n * num <= int(n[own].max()) * den))])
        at = at[np.argsort(n[at], kind="stable")]
        maps = np.empty((len(at), w), np.uint64)
        for k, i in enumerate(at.tolist()):
            m = np.frombuffer(bits[i], np.uint64)
            while len(m) > w:
                m = m[: len(m) // 2] | m[len(m) // 2 :]
            maps[k] = m
        if len(at) > 1:
            yield at, maps


def _texts(column) -> Iterator[tuple[int, list[list[bytes]]]]:
    at, some, n = 0, [], 0
    for k, t in enumerate(column):
        words = (t.as_py() or "").encode().lower().split()
        some.append(words)
        n += len(words)
        if n >= BATCH_WORDS:
            yield at, some
            at, some, n = k + 1, [], 0
    if some:
        yield at, some


class Components:
    """Union-find over the members of a block."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[inverse].tolist()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class SignatureTree:
    """Nodes over members sorted by size: halves of halves down to leaves of LEAF members."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, num: int, den: int, done: np.ndarray | None = None):
        self.sizes, self.maps, self.num, self.den = sizes, maps, num, den
        self.absent = ~maps
        #: Members that need no more partners: pairs of two of them are passed over.
        self.done = done

    def node(self, a: int, b: int) -> tuple:
        part = self.maps[a:b]
        return a, b, int(self.sizes[a]), int(self.sizes[b - 1]), np.bitwise_or.reduce(part), np.bitwise_and.reduce(part)

    def _enough(self, overlap: int, small: int, large: int) -> bool:
        """True if ``overlap`` of two sets at least ``small`` and ``large`` big reaches the similarity."""
        return (self.den + self.num) * overlap >= self.num * (small + large)

    def _may(self, u: tuple, v: tuple) -> bool:
        """False if no pair of the two nodes' members can be similar: by size range, then by largest overlap."""
        low, high = max(u[2], v[2]), min(u[3], v[3])
        if self.den * high < self.num * low:
            return False
        # Each bit that all of u have and none of v has is a shingle of u that v lacks.
        lost_u = int(np.bitwise_count(u[5] & ~v[4]).sum())
        lost_v = int(np.bitwise_count(v[5] & ~u[4]).sum())
        best = min(u[3] - lost_u, v[3] - lost_v)
        return self._enough(best, u[2], v[2])

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of members (x, y), x before y, that the bitmaps leave possible, leaf pair by leaf pair."""
        known: dict = {}

        def node(a: int, b: int) -> tuple:
            if (a, b) not in known:
                known[a, b] = self.node(a, b)
            return known[a, b]

        stack = [(0, len(self.sizes), 0, len(self.sizes))]
        while stack:
            a, b, c, d = stack.pop()
            same = a == c
            if self.done is not None and self.done[a:b].all() and self.done[c:d].all():
                continue
            if not same and not self._may(node(a, b), node(c, d)):
                continue
            if b - a <= LEAF and d - c <= LEAF:
                found = self._leaves(a, b, c, d)
                if len(found[0]):
                    yield found
                continue
            m, k = (a + b) // 2, (c + d) // 2
            if same:
                stack += [(a, m, m, b), (m, b, m, b), (a, m, a, m)]
            else:
                left = [(a, b)] if b - a <= LEAF else [(a, m), (m, b)]
                right = [(c, d)] if d - c <= LEAF else [(c, k), (k, d)]
                stack += [(*x, *y) for x in left for y in right]

    def _leaves(self, a: int, b: int, c: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = self.sizes[a:b, None], self.sizes[None, c:d]
        only_x = np.bitwise_count(self.maps[a:b, None] & self.absent[None, c:d]).sum(-1, dtype=np.int64)
        only_y = np.bitwise_count(self.absent[a:b, None] & self.maps[None, c:d]).sum(-1, dtype=np.int64)
        best = np.minimum(n - only_x, m - only_y)
        ok = (self.den + self.num) * best >= self.num * (n + m)
        if a == c:
            ok = np.triu(ok, 1)
        x, y = np.nonzero(ok)
        return x + a, y + c


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    overlap = int((both[1:] == both[:-1]).sum())
    return den * overlap >= num * (len(x) + len(y) - overlap)


def _first_pass(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at, texts in _texts(b.column(3)):
                sets = shingle_sets(words, texts, k)
                prefix = [prefix_of(key, length, num, den).view(np.int64) for key, length in sets]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                own, ids, rows = (b.column(c).slice(at, len(texts)) for c in range(3))
                yield pa.RecordBatch.from_arrays(
                    [
                        own, ids, rows, pa.array([len(s[0]) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s[0].tobytes()) if len(s[0]) else None for s in sets], pa.binary()),
                        pa.array([bitmap(s[0], ROUGH).tobytes() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix))),
                    ],
                    names=["own_id", "id", "row_key", "n", "content", "bits", "prefix"],
                )

    return docs.mapInArrow(run, "own_id long, id long, row_key long, n long, content binary, bits binary, prefix array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(class, n, bits, members) of the given classes' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at, some in _texts(b.column(1)):
                sets = [s[0] for s in shingle_sets(words, some, k)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(some)), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["class", "n", "bits", "members"],
                )

    return texts.select("class", "text").mapInArrow(run, "class long, n long, bits binary, members binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, list]]:
    """Consecutive rows of equal key columns, also across batches, as columns of Python values."""
    held: dict[str, list] | None = None
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
        cols = {name: b.column(keys + i).to_pylist() for i, name in enumerate(b.schema.names[keys:])}
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
            own = tuple(key[:, s].tolist())
            part = {n: v[s:e] for n, v in cols.items()}
            if held is not None and own == held_key:
                for n in held:
                    held[n] += part[n]
            else:
                if held is not None:
                    yield held
                held, held_key = part, own
    if held is not None:
        yield held


def _block(g: dict[str, list], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Positions in ``g`` of links that join different components: at most one less than there are members."""
    n = np.array(g["n"], np.int64)
    sets = [np.frombuffer(m, np.uint64) for m in g["members"]]
    parts = Components(np.array(g["class"], np.int64))
    for order, maps in width_groups(n, g["bits"], num, den):
        for xs, ys in SignatureTree(n[order], maps, num, den).pairs():
            for x, y in zip(order[xs].tolist(), order[ys].tolist()):
                if parts.find(x) != parts.find(y) and similar(sets[x], sets[y], num, den):
                    parts.join(x, y)
                    yield x, y


def _candidates(g: dict[str, list], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Positions in ``g`` of pairs of different components that the bitmaps leave possible."""
    n, part = np.array(g["n"], np.int64), np.array(g["part"], np.int64)
    for order, maps in width_groups(n, g["bits"], num, den):
        for xs, ys in SignatureTree(n[order], maps, num, den).pairs():
            x, y = order[xs], order[ys]
            other = part[x] != part[y]
            yield from zip(x[other].tolist(), y[other].tolist())


def _near(g: dict[str, list], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Positions in ``g``, each once as (x, x), of the classes that the bitmaps leave some partner."""
    n, cls = np.array(g["n"], np.int64), np.array(g["class"], np.int64)
    found = np.zeros(len(n), bool)
    for order, maps in width_groups(n, g["bits"], num, den):
        own = found[order]
        for xs, ys in SignatureTree(n[order], maps, num, den, own).pairs():
            other = cls[order[xs]] != cls[order[ys]]
            own[xs[other]] = True
            own[ys[other]] = True
        found[order] |= own
    for x in np.flatnonzero(found).tolist():
        yield x, x


BLOCK = ["token", "bucket", "i", "j"]


def _blocks(posted: DataFrame, num: int, den: int) -> DataFrame:
    """``posted`` (token, class, n, ...) with the block columns; rows of split blocks come once for each block.

    A token whose sets have over BLOCK_SHINGLES shingles together is split by
    set size, in steps of the similarity (sets of other than neighbouring
    steps are not similar), and each step into parts, of which all pairs of
    parts are blocks.
    """
    step = float(np.log(den / num)) if num < den else 1.0
    bucket = F.floor(F.log("n") / step).cast("int")
    heavy = posted.groupBy("token").agg(F.sum("n").alias("total")).where(F.col("total") > BLOCK_SHINGLES).select("token")
    heavy = materialise(heavy, "jaccard-heavy")
    if heavy.isEmpty():
        return posted.select(F.col("token"), *[F.lit(-1).alias(c) for c in BLOCK[1:]], *[c for c in posted.columns if c != "token"])
    light = posted.join(heavy, "token", "left_anti").select("token", *[F.lit(-1).alias(c) for c in BLOCK[1:]], *[c for c in posted.columns if c != "token"])
    both = posted.join(heavy, "token").withColumn("home", bucket)
    sizes = both.groupBy("token", "home").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    sizes = materialise(sizes, "jaccard-steps")
    above = sizes.select("token", (F.col("home") - 1).alias("home"), F.col("parts").alias("parts_above"))
    rows = both.join(sizes, ["token", "home"]).join(above, ["token", "home"], "left")
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    at_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.col("home").alias("bucket"), F.least(own, q).alias("i"), F.greatest(own, q).alias("j")))
    # As the smaller one it visits the next step's parts; those come to meet it as negative parts of their own.
    visits = F.transform(F.sequence(F.lit(0), F.col("parts_above") - 1), lambda q: F.struct((F.col("home") + 1).alias("bucket"), (-1 - own).alias("i"), q.alias("j")))
    below = sizes.select("token", (F.col("home") + 1).alias("home"), F.col("parts").alias("parts_below"))
    rows = rows.join(below, ["token", "home"], "left")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts_below") - 1), lambda q: F.struct(F.col("home").alias("bucket"), (-1 - q).alias("i"), own.alias("j")))
    none = F.array().cast("array<struct<bucket:int,i:int,j:int>>")
    every = F.concat(at_home, F.when(F.col("parts_above").isNotNull(), visits).otherwise(none), F.when(F.col("parts_below").isNotNull(), meets).otherwise(none))
    spread = rows.withColumn("at", F.explode(every))
    spread = spread.select("token", "at.bucket", "at.i", "at.j", *[c for c in posted.columns if c != "token"])
    return light.unionByName(spread)


def _in_blocks(rows: DataFrame, find, num: int, den: int) -> DataFrame:
    """(x, y): pairs of classes that ``find`` gives for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs: list[int] = []
        ys: list[int] = []
        for g in _groups(batches, len(BLOCK)):
            for x, y in find(g, num, den) if len(g["n"]) > 1 else ():
                xs.append(g["class"][x])
                ys.append(g["class"][y])
                if len(xs) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])
                    xs, ys = [], []
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "x long, y long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(class, part): the smallest class of each connected component, for the classes of the edges.

    Labels of neighbours are taken over and then followed one step further, so
    the rounds grow with the logarithm of the longest chain. Each round's
    labels are a written table.
    """
    both = materialise(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "jaccard-edges")
    labels = materialise(both.groupBy(F.col("x").alias("class")).agg(F.least(F.min("y"), F.col("class")).alias("part")), "jaccard-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("class").alias("y"), F.col("part").alias("theirs")), "y").groupBy(F.col("x").alias("class")).agg(F.min("theirs").alias("theirs"))
        took = labels.join(near, "class").select("class", F.least("part", "theirs").alias("next"), F.col("part").alias("was"))
        far = labels.select(F.col("class").alias("next"), F.col("part").alias("beyond"))
        new = materialise(took.join(far, "next", "left").select("class", F.least("next", F.coalesce("beyond", "next")).alias("part"), "was"), "jaccard-labels")
        labels = new.select("class", "part")
        if new.where("part <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(own_id, id, row_key, n_shingles, component, component_id): one row per row of ``docs``.

    A-Z is lower-cased and words are split at ASCII white space. A text's set
    holds its distinct ``k``-word shingles; a shorter text's set is its whole
    word sequence; a text without words (or null) has an empty set and is
    linked with nothing. Texts link when ``den * intersection >= num * union``;
    ``component`` names what is reachable by links and ``component_id`` is the
    smallest id in it. A null id is smaller than any other; repeated rows have
    equal sets and so link. A very long text has one large set, split with its
    block; an empty table gives an empty result; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("own_id"), id_key(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_key"), F.col(text_col).cast("string").alias("text"))
    wide = materialise(_first_pass(d, k, num, den).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets")
    seen = materialise(wide.drop("prefix", "bits"), "jaccard-rows")
    # Equal sets are one class, named after the row of its smallest id.
    groups = seen.where("content is not null").groupBy("content").agg(F.min(F.struct("id", "row")).alias("top"), F.count("*").alias("size")).where("size > 1").select("content", F.col("top.row").alias("top"))
    seen = materialise(seen.join(groups, "content", "left").withColumn("class", F.when(F.col("content").isNotNull(), F.coalesce("top", "row"))).drop("content", "top"), "jaccard-classes")
    copies = seen.where("class <> row").select("row")
    one = wide.where("content is not null").join(copies, "row", "left_anti")

    # Shingles of the prefixes that different classes share.
    posted = one.select(F.explode("prefix").alias("token"), F.col("row").alias("class"))
    tokens = materialise(posted.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("token"), "jaccard-tokens")
    posted = materialise(posted.join(tokens, "token"), "jaccard-posted")
    maps = materialise(one.select(F.col("row").alias("class"), "n", "bits", "id", "row_key"), "jaccard-bitmaps")
    discard(wide)

    # Classes that the bitmaps leave a possible partner; only their sets are needed.
    flagged = _in_blocks(_blocks(posted.join(maps.select("class", "n", "bits"), "class"), num, den).select(*BLOCK, "class", "n", "bits"), _near, num, den)
    near = materialise(flagged.select(F.col("x").alias("class")).distinct(), "jaccard-near")
    posted = materialise(posted.join(near, "class", "left_semi"), "jaccard-posted")
    own = materialise(maps.join(near, "class", "left_semi").select("class", "id", "row_key"), "jaccard-owners")
    discard(maps)
    # Few documents have a possible partner: a table of checked size meets the texts where they are read.
    texts = d.select("id", "row_key", "text").join(F.broadcast(own) if own.count() <= BROADCAST_ROWS else own, ["id", "row_key"])
    # A repeated row brings its class twice, which links nothing new.
    sets = materialise(_sets(texts, k), "jaccard-members")
    maps = sets.select("class", "n", "bits").dropDuplicates(["class"])

    # First in full by a few shared shingles, which finds nearly all links ...
    tokens_of = posted.groupBy("class").agg(F.array_sort(F.collect_set("token")).alias("tokens")).join(maps.select("class", "n"), "class")
    probes = tokens_of.select(F.explode(F.slice("tokens", 1, F.when(F.col("n") <= SHORT, PROBES).otherwise(1))).alias("token"), "class")
    full = _blocks(probes.join(sets, "class"), num, den)
    edges = materialise(_in_blocks(full.select(*BLOCK, "class", "n", "members", "bits"), _block, num, den), "jaccard-links")
    parts = components(edges)

    # ... then by bitmaps over all shared shingles, for pairs that are not yet joined.
    labelled = posted.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))
    open_tokens = labelled.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("token")
    rest = labelled.join(open_tokens, "token").join(maps.select("class", "n", "bits"), "class")
    maybe = _in_blocks(_blocks(rest, num, den).select(*BLOCK, "class", "n", "part", "bits"), _candidates, num, den)
    maybe = materialise(maybe.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "jaccard-maybe")
    left = maybe.join(sets.select(F.col("class").alias("x"), F.col("members").alias("mx")), "x").join(sets.select(F.col("class").alias("y"), F.col("members").alias("my")), "y")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), num, den) for p, q in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    found = materialise(left.select("x", "y", "mx", "my").mapInArrow(verify, "x long, y long"), "jaccard-links")
    if not found.isEmpty():
        parts = components(edges.unionByName(found))

    named = seen.select("own_id", "id", "row_key", "n", "class").join(parts, "class", "left").withColumn("component", F.coalesce("part", "class"))
    low = named.where("component is not null").groupBy("component").agg(F.min("id").alias("low"), F.count("*").alias("members")).where("members > 1").select("component", "low")
    smallest = F.coalesce("low", "id")
    return named.join(low, "component", "left").select(
        "own_id", "id", "row_key", F.col("n").alias("n_shingles"), "component", F.when(smallest != NULL_ID, smallest).alias("component_id")
    )


def near_dup_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of linked texts; texts without words all stay.

    A null id is below all others, null text has no words, of repeated rows
    one stays. Texts of any length are compared by all their shingles; columns
    of any other name go through as they are; an empty table gives no rows.
    """
    joined = materialise(jaccard_join(docs, id_col, text_col, k, num, den), "jaccard-verdicts")
    chosen = joined.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "row_key")).alias("of"))
    kept = chosen.select("of.id", "of.row_key", F.lit(True).alias("single"))
    blank = joined.where("component is null").select("id", "row_key", F.lit(False).alias("single")).distinct()
    return keep_rows(docs, kept.unionByName(blank), id_col, text_col)
