"""The corpus operators against brute force on small tables with every edge case in them."""

import collections
import hashlib
import io
import random
import re
import zipfile

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tally.llm import bpe, common, exact_dedup, jaccard_join, line_dedup, mixing, quality, sstable, substring_dedup, token_counts, warc_zip  # noqa: E402

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_lines string, kept string, h1 string, row string, id string"
#: Columns whose names clash with inner and outer ones.
CLASH = ("x",) * 5


def table(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", *CLASH) for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "dé", "the", "of", "x1", "omega,", "naïve", "q"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(1, 90)) for _ in range(25)]
    line = "A line that is certainly long enough to be counted here"
    docs = base + base[:6] + [b.upper() for b in base[:3]]
    docs += [b + " tail" for b in base[:8]] + [f"{text(3)}\n  {line.upper()}\t\n{text(4)}\n{line}" for _ in range(7)]
    docs += [None, "", " \n\t ", "one", "two words", "same same same same " * 10, "word " * 3000, "ab" * 4000, "<|endoftext|> it's we're\n\n  x\t<|endo 1234 日本語 🙂"]
    return [(3 * k + 1, t) for k, t in enumerate(docs)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("a_part", [100_000, 7])
def test_lines(spark, pairs, monkeypatch, a_part):
    monkeypatch.setattr(line_dedup, "LINES_A_PART", a_part)
    df = table(spark, pairs)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.apply_bitmaps(df, line_dedup.line_bitmaps(df)).collect()}
    holders = collections.defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in pairs:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert sum(v[1] for v in got.values()) > 5


def test_lines_of_very_long_texts_null_ids_repeats_and_empty_tables(spark):
    line = lambda k: f"line {k} that is long enough to be counted as one of many"
    many = "\n".join(f"{line(k % 9)}\nkeep {k}" for k in range(100_000))
    rows = [(1, many), (None, line(0)), (None, line(0)), (5, line(1)), (5, line(1)), *[(100 + k, "\n".join(map(line, range(9)))) for k in range(5)]]
    df = table(spark, rows)
    got = line_dedup.apply_bitmaps(df, line_dedup.line_bitmaps(df)).collect()
    assert len(got) == len(rows)
    long = next(r for r in got if r.doc_id == 1)
    assert (long.n_lines, long.n_dropped) == (200_000, 100_000) and long.kept_text == "\n".join(f"keep {k}" for k in range(100_000))
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got if r.doc_id != 1) == [(0, 1), (0, 1), (5, 1), (5, 1), *[(100 + k, 9) for k in range(4)], (104, 0)]
    none = table(spark, [])
    assert line_dedup.apply_bitmaps(none, line_dedup.line_bitmaps(none)).count() == 0


def test_bpe_round_trip(spark, pairs):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.encode_documents(table(spark, pairs), RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(coded, RANKS, public_tokenizers.PATTERN).collect()}
    ids = {r.doc_id: r.ids for r in coded.collect()}
    for i, t in pairs:
        assert ids[i] == enc.encode_ordinary(t or "") and back[i] == (t or "").encode()
        assert bpe.encode(enc, t, size=7) == ids[i]


LONG_RUNS = [" ", "\n", "\t", " \t", "\u3000 "]


@pytest.mark.parametrize("white", LONG_RUNS)
def test_bpe_of_long_white_space(white):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for n in (60_000, 400_000):
        run = (white * n)[:n]
        for text in (run, "word" + run, run + "word", "a" + run + " b" + run + ", c"):
            assert bpe.encode(enc, text) == enc.encode_ordinary(text)
    for text in ((white * 2_000_000)[:2_000_000], "one" + (white * 2_000_000)[:2_000_000] + "two"):
        assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()


@pytest.mark.parametrize("white,most", [(" ", 2_000_000), ("\n", 300_000), ("\t", 300_000), ("\u3000 ", 300_000)])
def test_counts_and_ids_of_long_white_space(white, most):
    from tokenizers import Tokenizer

    tok, encoder, count = Tokenizer.from_file(JSON), sstable.IdEncoder(JSON, 0), token_counts.counter(JSON)
    for n in (3_000, most):
        for text in ("a\t b" + (white * n)[:n] + "end", (white * n)[:n]):
            ids = tok.encode(text, add_special_tokens=False).ids
            assert count.document(text)[1] == len(ids)
            assert np.frombuffer(encoder.document(text), encoder.dtype).tolist() == [*ids, 0]


def test_prefix_counts_of_many_pieces_at_once_are_those_of_each():
    rng, one = random.Random(8), token_counts.PrefixCounter(JSON)
    letters = ["a", "b", "e", "n", "th", "ing", "ü", "ß", "é", "1", "##", "%", "日", "🙂"]
    pieces = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 14))).encode() for _ in range(3000)} | {b"a" * n for n in range(1, 40)} | {(" " + "ñ" * n).encode() for n in range(1, 23)})
    for group, counts in one.batches.groups(pieces):
        for b, row in zip(group, counts):
            assert row[1 : len(b) + 1].tolist() == one.piece(b)
    long = ["ü" * 47 + " " + "ñé" * 24, "x" * 200 + " it's\nüber " + "é" * 48]
    one.prepare(long)
    assert [one.document(t)[0] for t in long] == [token_counts.PrefixCounter(JSON).document(t)[0] for t in long]


def test_token_counts_at_every_prefix(spark, pairs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    n = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.token_counts(table(spark, pairs), JSON).collect()}
    for i, t in pairs:
        t = t or ""
        assert (got[i].n_bytes, got[i].n_tokens) == (len(t.encode()), n(t))
        if len(t) < 120:
            counts = token_counts.prefix_counts(bytes(got[i].prefix_changes))
            assert [counts[len(t[:k].encode())] for k in range(len(t) + 1)] == [n(t[:k]) for k in range(len(t) + 1)]
            cut = token_counts.longest_within(bytes(got[i].prefix_changes), t, 5)
            assert n(t.encode()[:cut].decode()) <= 5
        whole, cut = t.encode(), got[i].bytes_in_budget
        assert n(whole[:cut].decode()) <= 1024 and (cut == len(whole) or n(t[: len(whole[:cut].decode()) + 1]) > 1024)


def test_token_counts_of_special_strings_null_ids_and_empty_tables(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    many = "<|endoftext|>" * 100_000
    rows = [(1, many), (None, "a<|endoftext|> b<|endoftext|>"), (None, "x"), (2, "dup"), (2, "dup"), (3, " " * 3000 + "-" * 3000)]
    got = token_counts.token_counts(table(spark, rows), JSON).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((i or 0, len(tok.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert next(r for r in got if r.doc_id == 1).bytes_in_budget == 1024 * 13
    assert token_counts.token_counts(table(spark, []), JSON).count() == 0


def test_exact_dedup(spark, pairs, monkeypatch):
    rows = [*pairs, pairs[0], pairs[0], (None, pairs[1][1]), (None, "lonely"), (None, "lonely")]
    monkeypatch.setattr(common, "PART_ROWS", 2)
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    by_digest = {sha(t): g for t, g in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        own = by_digest[bytes(r.digest).hex()]
        assert (r.group_size, r.keep_id) == (len(own), max((i for i in own if i is not None), default=None))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup_filter(table(spark, rows)).count() == len(groups)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_cuckoo_index_inserts_deletes_and_grows(spark):
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    index = exact_dedup.CuckooIndex(16)
    for k in keys:
        index.put(k)
    assert index.resizes > 0 and all(map(index.meets, keys))
    assert all(index.remove(k) for k in keys[::2]) and not index.remove(keys[0])
    assert all(map(index.meets, keys[1::2])) and sum(map(index.meets, keys[::2])) < 30
    live = exact_dedup.DigestIndex(spark, 4 * exact_dedup.BUCKET_KEYS)
    batch = lambda some: spark.createDataFrame([(n, k, bytearray(keys[n])) for k, n in enumerate(some)], "id bigint, at bigint, digest binary")
    table_of = lambda: sorted((r.keep, r.group_size) for r in live.table.collect())
    assert live.insert(batch(range(5))).count() == 0 and table_of() == [(n, 1) for n in range(5)]
    live.delete(batch([0, 9]))
    assert [(r.keep, r.group_size, r.is_new) for r in live.insert(batch([0, 1, 1])).collect()] == [(1, 3, False)]
    assert table_of() == [(0, 1), (1, 3), (2, 1), (3, 1), (4, 1)]
    assert [(r.keep, r.is_new) for r in live.insert(batch([7, 7])).collect()] == [(7, True)]


def test_warc_zip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 50, "<p>a</p>", "x"]
    pages = spark.createDataFrame([(10 + k, f"http://x/{k}", h, "c") for k, h in enumerate(html)], "page_id bigint, url string, html string, refers_to string")
    manifest = warc_zip.write_archives(pages)
    got = {r.page_id: r for r in warc_zip.read_archives(manifest, with_payload=True).collect()}
    for k, h in enumerate(html):
        same = [10 + j for j, o in enumerate(html) if (o or "") == (h or "")]
        r = got[10 + k]
        assert r.payload_bytes == len((h or "").encode()) and r.payload_digest == warc_zip.sha1_base32((h or "").encode())
        assert (r.record_type, r.refers_to) == (("response", None) if 10 + k == max(same) else ("revisit", max(same)))
    for r in manifest.collect():  # another reader agrees with ours
        with zipfile.ZipFile(r.archive.removeprefix("file:")) as z:
            assert z.testzip() is None and set(z.namelist()) == {"archive/pages.warc.gz", "indexes/pages.idx"}
    big = warc_zip.read_archives(warc_zip.write_archives(pages, min_bytes=10, path=(tmp_path / "a").as_uri()))
    assert big.where("record_type = 'revisit'").count() == 0


def test_warc_zip_of_hot_payloads_odd_ids_long_pages_and_no_pages(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 3)
    monkeypatch.setattr(warc_zip, "ARCHIVE", 4000)
    rows = [(k, f"u{k}", "") for k in range(40)] + [(None, None, "n"), (None, "b", "n"), (50, "r", "same"), (50, "r", "same"), (60, "l", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc_zip.write_archives(pages)
    got = warc_zip.read_archives(manifest).collect()
    assert len(got) == len(rows) and manifest.count() > 2
    assert sorted(r.page_id for r in got if r.refers_to == 39) == list(range(39))
    assert [r.record_type for r in got if r.page_id in (39, 50, 60, None)] == ["response"] * 6
    assert next(r for r in got if r.page_id == 60).payload_bytes == 2_000_000
    assert warc_zip.read_archives(warc_zip.write_archives(pages.where("false"))).count() == 0


def test_zip_reader_takes_plain_archives():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a", b"stored")
        z.writestr("b", b"packed", compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    f = File(raw.getvalue())
    at, n = warc_zip.stored_members(f)["a"]
    assert f.getvalue()[at : at + n] == b"stored" and len(warc_zip.stored_members(f)) == 1


def brute_substrings(pairs, width):
    first = {}
    for i, t in sorted(pairs):
        w = words_of(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in pairs:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substrings_and_near_copies_of_hot_texts_odd_ids_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 3)
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    shared, copied = words(30), words(40)
    rows = [(k, f"{words(20)} {shared} {words(20)}") for k in range(12)] + [(100 + k, copied) for k in range(12)] + [(200, words(30_000) + " " + shared), (201, None)]
    df = table(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == brute_substrings(rows, 13)
    odd = [(None, shared), (None, shared), (1, shared + " x"), (1, shared + " x")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(table(spark, odd)).collect())
    assert got == {(None, 30, 0): 2, (1, 31, 30): 2}
    joined = {r.own_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(df).collect()}
    assert joined == brute_links(rows, 3, 90, 100)
    got = collections.Counter((r.own_id, r.component_id) for r in jaccard_join.jaccard_join(table(spark, odd)).collect())
    assert got == {(None, None): 2, (1, None): 2}
    none = table(spark, [])
    assert substring_dedup.substring_dedup(none).count() == jaccard_join.jaccard_join(none).count() == jaccard_join.near_dup_filter(none).count() == 0
    encoded = bpe.encode_documents(table(spark, [(None, "a"), (1, "b"), (1, "b")]), RANKS, public_tokenizers.PATTERN)
    assert sorted(r.doc_id or 0 for r in encoded.collect()) == [0, 1, 1] and bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_substrings(spark, pairs):
    rng = random.Random(5)
    letters = [(1000 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    for rows in (pairs, letters):
        for width in (13, 5):
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table(spark, rows), width=width).collect()}
            assert got == brute_substrings(rows, width)


def test_substrings_of_long_runs_copies_and_wide_windows(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    shared, run = words(60), "x " * 3 * substring_dedup.LONGEST
    rows = [(k, f"{words(rng.randint(0, 30))} {shared} {words(rng.randint(0, 30))}") for k in range(20)]
    rows += [(100, run + shared), (101, "y " + run + "x z"), (102, shared), (103, shared), (104, ""), (105, None)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table(spark, rows), width=40).collect()}
    assert got == brute_substrings(rows, 40)
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(table(spark, rows), width=2 * substring_dedup.LONGEST + 1)


def dealt(spark):
    """Rows and bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    done = [stages.apply(k) for k in range(stages.size())]
    return np.array([sum(x.shuffleWriteRecords() for x in done), sum(x.shuffleWriteBytes() for x in done)])


def test_substrings_deal_few_rows_and_bytes_for_many_different_pairs(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(n))
    shared = words(30)
    rows = [(k, f"{words(300)} {shared} {words(300)}") for k in range(400)]
    n_words, df = 630 * len(rows), table(spark, rows).repartition(2).localCheckpoint()
    before = dealt(spark)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).collect()}
    n_rows, n_bytes = dealt(spark) - before
    assert got == brute_substrings(rows, 13)
    assert n_rows < n_words / 100 and n_bytes < 15 * n_words


def test_quality_statistics(spark, pairs):
    got = {r.doc_id: r for r in quality.quality_verdicts(table(spark, pairs)).collect()}
    for i, t in pairs:
        w = words_of(t)
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(k, " ".join(word() + ("***" if k % 20 == 0 else "") for _ in range(120))) for k in range(400)]
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(table(spark, rows)).collect()}
    assert got == {k: k % 20 != 0 for k in range(400)}
    assert quality.quality_filter(table(spark, rows)).count() == 380
    assert abs(quality.chi_square_cdf(quality.chi_square_quantile(0.9, 4), 4) - 0.9) < 1e-9 and abs(quality.chi_square_quantile(0.95, 1) - 3.841459) < 1e-5


def test_quality_estimate_against_brute_force_minimum_determinant(spark):
    rng = np.random.default_rng(8)
    d, share = quality.D, 0.75
    base = rng.normal(0, 1, (120, d)) @ np.diag([0.2, 0.5, 0.4, 0.3, 0.2]) + rng.normal(0, 0.3, (120, 1))
    base[:24] += 4  # a fifth of the rows lies elsewhere, close together
    x = np.round(base * quality.UNIT).astype(np.int64)
    rows = spark.createDataFrame([("en", "s", row.tolist()) for row in x], "lang string, source string, x array<bigint>")
    got = quality.fit(rows).first()
    floor = np.diag([v**2 for v in quality.STATISTICS.values()])
    scale = share / quality.chi_square_cdf(quality.chi_square_quantile(share, d), d + 2)
    u, h = x / quality.UNIT, int(np.ceil(share * len(x)))

    def estimate(at):
        c = u[at]
        return c.mean(0), np.cov(c.T, bias=True) * scale + floor

    best = np.inf
    for _ in range(200):
        at = rng.choice(len(u), d + 1, replace=False)
        for _ in range(30):
            mean, cov = estimate(at)
            at = np.argsort(((u - mean) @ np.linalg.inv(cov) * (u - mean)).sum(1))[:h]
        best = min(best, np.linalg.slogdet(estimate(at)[1])[1])
    low = np.zeros((d, d))
    low[np.tril_indices(d)] = got.factor
    assert abs(2 * np.log(np.diag(low)).sum() - best) < 0.1 and np.abs(np.array(got.centre) - u[24:].mean(0)).max() < 0.2


def test_quality_of_null_groups_pools_repeats_and_empty_tables(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(80))
    rows = [(k, text(), lang, source) for k, (lang, source) in enumerate([("en", "a")] * 40 + [("de", "b")] * 3 + [(None, None)] * 30 + [("fr", None)] * 2)]
    rows += [(None, rows[0][1], "en", "a"), (1, rows[1][1], "en", "a"), (90, "long word " * 300_000, "en", "a"), (91, None, "en", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = quality.quality_verdicts(df).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id not in (90, 91)) and not any(r.kept for r in got if r.doc_id in (90, 91))
    assert quality.quality_filter(df).count() == len(rows) - 2
    assert quality.quality_verdicts(df.where("false")).count() == 0


def brute_links(pairs, k, num, den):
    sets = {}
    for i, t in pairs:
        w = words_of(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, None), (5, 80, 100, None), (3, 70, 100, 300)])
def test_jaccard(spark, pairs, monkeypatch, k, num, den, block):
    if block:
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    got = {r.own_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(table(spark, pairs), k=k, num=num, den=den).collect()}
    assert got == brute_links(pairs, k, num, den)


def test_near_dup_filter(spark, pairs):
    rows = [*pairs, pairs[0], pairs[0]]
    kept = jaccard_join.near_dup_filter(table(spark, rows))
    want = brute_links(pairs, 5, 80, 100)
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_sstable(spark, pairs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    rows = [*pairs, (None, "null id"), (pairs[0][0], "again")]
    manifest = sstable.write_shards(table(spark, rows), JSON, path=str(tmp_path / "without-a-scheme"))
    back = sstable.read_shards(manifest)
    assert back.rdd.getNumPartitions() == manifest.count() > 1
    got = back.collect()
    assert len(got) == len(rows) and sorted(r.doc_id is None for r in got)[-1]
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    texts = {i: t for i, t in pairs[1:]}
    for r in got:
        if r.doc_id in texts:
            assert r.ids == tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
            assert r.ids_crc32 == __import__("zlib").crc32(np.array(r.ids, "<u4").tobytes())
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    wanted = spark.createDataFrame([(pairs[5][0],), (pairs[0][0],), (-99,), (2,), (None,)], "doc_id bigint")
    found = collections.Counter(r.doc_id for r in sstable.lookup(manifest, wanted).collect())
    assert found == {pairs[5][0]: 1, pairs[0][0]: 2, None: 1}
    assert sstable.read_shards(sstable.write_shards(table(spark, []), JSON)).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(2)
    words = ["tree", "house", "river", "stone", "cloud", "light"]
    docs, labels = [], []
    for k in range(300):
        kind = ("clean", "low", "toxic")[0 if k % 10 < 6 else 1 if k % 10 < 8 else 2]
        w = [rng.choice(words) for _ in range(60)]
        if kind == "low":
            w = [x.upper() + "***" for x in w]
        if kind == "toxic":
            w[::9] = ["nasty"] * len(w[::9])
        docs.append((k, " ".join(w)))
        if k % 2:
            labels.append((k, int(kind != "low"), int(kind == "toxic")))
    docs += [(None, None), (7, ""), (8, docs[8][1])]
    df = table(spark, docs)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = mixing.fit_classifier(df, lab)
    soft = mixing.materialise(mixing.posteriors(df, model), "soft")
    held = {r.id: r.p for r in soft.collect() if r.id in range(0, 300, 2)}
    assert all(max(range(3), key=lambda d: held[k][d]) == (0 if k % 10 < 6 else 1 if k % 10 < 8 else 2) for k in held if k != 8)
    targets = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    rated, report = mixing.solve_rates(soft, targets)
    for d in mixing.DOMAINS:
        assert abs(report["reached"][d] - report["goal"][d]) <= 1e-4 * report["total"]
    assert rated.where("rate < 0").count() == 0 and rated.count() == len(docs)
    mixed = mixing.mix(df, lab, targets=targets)
    assert mixed.columns == df.columns
    clean = {r.doc_id for r in mixed.collect()}
    assert all(k in clean for k, _ in docs[:300] if k % 10 < 6)
    none = mixing.mixing_rates(df, lab.where("false")).collect()
    assert len(none) == len(docs)


def test_mixing_solver_against_brute_force_least_squares(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 40).round(6)
    t = rng.integers(0, 500, 40)
    soft = spark.createDataFrame([(int(n), [float(v) for v in q]) for n, q in zip(t, p)], "n_tokens bigint, p array<double>")
    for targets in ({"clean": 0.6, "low": 0.3, "toxic": 0.1}, {"clean": 0.95, "low": 0.03, "toxic": 0.02}):
        goal = t.sum() * np.array([targets[d] for d in mixing.DOMAINS])
        metric = np.linalg.inv((p * t[:, None]).T @ p)
        rate = np.ones(40)
        for _ in range(100_000):
            rate = np.maximum(0, rate - p @ (metric @ (p.T @ (t * rate) - goal)))
        want = p.T @ (t * rate)
        far = lambda x: (x - goal) @ metric @ (x - goal)
        rated, report = mixing.solve_rates(soft, targets)
        got = np.array([report["reached"][d] for d in mixing.DOMAINS])
        assert far(got) <= far(want) * 1.05 + 1e-3 and report["met"] == (abs(got - goal).max() <= 1e-4 * t.sum())
        rates = [(r.n_tokens, r.p, r.rate) for r in rated.collect()]
        assert min(r for *_, r in rates) >= 0 and np.allclose(sum(n * r * np.array(q) for n, q, r in rates), got, atol=0.01)


def test_mixing_of_an_empty_table(spark):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert mixing.mixing_rates(table(spark, []), lab).count() == 0 and mixing.mix(table(spark, []), lab).count() == 0
