"""Operators against brute force on small tables with odd rows."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import blocks as bl
from weft.llm import textops as tx
from weft.llm.decontaminate import decontaminate
from weft.llm.licenses import KNOWN, MIT, known_licenses, scan_licenses
from weft.llm.mixing import mix_sources
from weft.llm.quality import LINE_LIMIT, NGRAM_LIMITS, measure, repetition
from weft.llm.suffixes import equal_strings, multikey_order, remove_repeated_bytes
from weft.llm.tokenstore import Encoder, Shard, ShardWriter, key_of, store_tokens
from weft.llm.windows import levels, remove_repeated

SPACE = r"[^\x20\x09-\x0d]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_rows(seed=1, n=60):
    """Nulls, empties, copies, near copies, repeated rows, and a clashing extra column."""
    rng = random.Random(seed)
    words = ["a", "b", "The", "é", "x1", "z,", "#", "漢字", "it's", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), f"s{i % 3}", "row") for i in range(n)]
    rows += [(n + i, rows[i][1], "s0", "copy") for i in range(8)]
    rows += [(n + 20, None, None, "null"), (n + 21, "", "s1", "empty"), (n + 22, " \t\n ", "s1", "blank"), (3, rows[3][1], "s0", "again"), (None, rows[4][1], "s2", "no id")]
    return rows


def docs(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id string").repartition(parts)


SCHEMA = "doc_id long, text string, source string, id string"


# ---- decontamination ----


def windows_of(text, n=10):
    w = re.findall(WORD, low(text))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_decontaminate_matches_brute_force(spark):
    rows = odd_rows()
    long_item = " ".join(re.findall(WORD, low(rows[5][1] + " tail of it"))[:14])
    items = [(1, long_item), (2, "The a b"), (10, None), (11, ""), (None, "a a"), (3, " ".join(re.findall(WORD, low(rows[9][1]))[2:13])), (3, "x1"), (4, "漢字 é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 0):  # broadcast and shuffled benchmark side
        got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate(docs(spark, rows), bench, broadcast_rows=limit).collect()}
        want = set()
        for i, text, *_ in rows:
            w = re.findall(WORD, low(text))
            hit, found = set(), set()
            for item, t in items:
                for win in windows_of(t) if item is not None else ():
                    for s in range(len(w) - len(win) + 1):
                        if tuple(w[s : s + len(win)]) == win:
                            hit |= set(range(s, s + len(win)))
                            found.add(str(item))
            want.add((i, len(w), len(hit), tuple(sorted(found))))
        assert got == want


def test_decontaminate_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs(spark, odd_rows()), none).where("n_hit > 0").count() == 0
    assert decontaminate(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_decontaminate_a_very_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    items = spark.createDataFrame([("a", " ".join(words[120_000:120_030])), ("b", " ".join(f"z{i}" for i in range(30)))], "item_id string, text string")
    df = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "doc_id long, text string")
    for limit in (200_000, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(df, items, broadcast_rows=limit).collect()}
        assert got == {1: (150_000, 30, ["a"]), 2: (1, 0, [])}


def test_winnowing_keeps_a_fingerprint_of_every_window(spark):
    from weft.llm.decontaminate import fingerprints, hash_of

    rng = random.Random(4)
    span = [str(rng.randint(0, 9)) for _ in range(10)]
    rows = [(k, [str(rng.randint(0, 9)) for _ in range(k)] + span + ["q"] * k) for k in range(12)]
    df = spark.createDataFrame(rows, "k int, w array<string>").select("k", F.transform(fingerprints(F.col("w"), 10, 5), hash_of).alias("h"))
    own = set(spark.createDataFrame([(span,)], "w array<string>").select(F.transform(fingerprints(F.col("w"), 10, 5), hash_of).alias("h")).first().h)
    assert all(own & set(r.h) for r in df.collect())


# ---- mixing ----


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = share * sum(sizes.values()), {}, list(names)
    left = total
    while open_:
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * sizes[s]]
        if not over:
            out.update({s: left * w[s] / sum(w[x] for x in open_) for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("fan", [256, 4])
def test_mixing_targets_and_copies(spark, fan):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "c", "d", None, "é"]), "x") for i in range(400)] + odd_rows()
    df = docs(spark, rows)
    got = mix_sources(df, fan=fan).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(SPACE, t or ""))
    sizes = Counter()
    for _, t, s, _x in rows:
        sizes[s] += size(t)
    want = water_fill(sizes)
    largest = max(size(t) for _, t, _s, _x in rows)
    taken = Counter()
    source = {}
    for i, t, s, _x in rows:
        source.setdefault((i, size(t)), set()).add(s)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        fits = [s for s in source[(r.doc_id, r["size"])] if sizes[s] == r.source_size]
        assert fits and abs(r.target - want[fits[0]]) < 1e-6 * max(1, r.target)
        taken[fits[0]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= largest  # all but one fraction of a source end whole
    again = mix_sources(df.repartition(2), fan=fan).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]


def test_mixing_of_many_equal_rows(spark):
    """Equal rows are spread over the leaves, whatever partitions they come in."""
    rows = [(None, "a b c", "s", "x")] * 20_000 + [(i, "w " * (i % 9 + 1), "t", "x") for i in range(500)]
    sums = []
    for parts in (2, 5):
        got = mix_sources(docs(spark, rows, parts))
        assert got.where("taken > 2 * size").isEmpty()
        sums.append(sorted(map(tuple, got.groupBy("doc_id", "source_size", "taken").count().collect()), key=str))
        one = got.where("doc_id is null").agg(F.sum("taken"), F.max("target"), F.count_distinct("taken")).first()
        assert abs(one[0] - one[1]) <= 3 and one[2] <= 3
    assert sums[0] == sums[1]


def test_mixing_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = mix_sources(docs(spark, [(1, None, None, "x"), (2, "  ", "a", "x")])).collect()
    assert {(r["size"], r.taken, r.target) for r in alone} == {(0, 0, 0.0)}


# ---- windows and byte strings ----


def brute_windows(rows, n):
    words = [re.findall(SPACE, t or "") for _, t, *_ in rows]
    least = {}
    for (i, *_), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - n + 1):
                g = tuple(w[k : k + n])
                least[g] = min(least.get(g, i), i)
    out = []
    for (i, *_), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and least[tuple(w[k : k + n])] < i:
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_levels_double():
    assert levels(13) == [4, 8, 13] and levels(100) == [4, 8, 16, 32, 64, 100] and levels(4) == [4] and levels(2) == [2] and levels(8, 2) == [2, 4, 8]


def test_doubling_ends_without_candidates(spark, monkeypatch):
    """Texts that share six words and no more: nothing survives eight, so no further level is taken."""
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(50)] + [f"s{k}" for k in range(6)] + [f"v{i}x{k}" for k in range(50)]), "s", "x") for i in range(4)]
    asked = []
    exchange = bl.exchange
    monkeypatch.setattr(bl, "exchange", lambda *a: asked.append(a) or exchange(*a))
    got = remove_repeated(docs(spark, rows), window=40, texts=False).collect()
    assert all(r.n_removed == 0 for r in got) and len(asked) <= 3 < len(levels(40))  # four words, eight at most, whole spans (of which there are none)


def test_very_long_text_of_words(spark):
    words = [f"w{i}" for i in range(120_000)]
    rows = [(1, " ".join(words), "s", "x"), (2, " ".join(["new", *words[50_000:50_100], "end"]), "s", "x")]
    assert {r.doc_id: r.n_removed for r in remove_repeated(docs(spark, rows), texts=False).collect()} == {1: 0, 2: 100}


@pytest.mark.parametrize("n", [13, 4, 2, 40])
def test_repeated_windows(spark, n):
    rows = odd_rows(n)
    got = [tuple(r) for r in remove_repeated(docs(spark, rows, 4), window=n).collect()]
    assert sorted(got, key=str) == brute_windows(rows, n)


def brute_bytes(rows, n):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "hot"), [(200, 4096), (20, 4096), (200, 0), (20, 2)])
def test_repeated_bytes(spark, n, hot):
    rng = random.Random(n)
    passage = " ".join(f"p{rng.randint(0, 99)}" for _ in range(40))
    shared = [(600 + k, f"{'q' * (k % 7)}{rng.randint(0, 9)} {passage} {rng.randint(0, 9)}", "s", "x") for k in range(30)]
    rows = shared + odd_rows(n) + [(500, "ab" * 300, "s", "x"), (501, "x" * 199, "s", "x"), (502, "y" * 201, "s", "x")]
    got = remove_repeated_bytes(docs(spark, rows, 4), length=n, texts=False, hot=hot).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got], key=str) == brute_bytes(rows, n)


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 300):
        words = rng.integers(0, 3, (n, 6)).astype(np.uint64) << np.uint64(62)  # many ties, numbers above 2**63
        order = multikey_order(words)
        assert sorted(order.tolist()) == list(range(n)) and words[order].tolist() == sorted(words.tolist())


def test_equal_strings_around_one_lead():
    """Strings with one lead at several places, with zero bytes and ends that differ."""
    rng = random.Random(9)
    lead, length = bytes(range(8)), 12
    parts, sizes, leads, want = [], [], [], []
    for _ in range(60):
        left = bytes(rng.choice([0, 65]) for _ in range(rng.randint(0, 4)))
        right = bytes(rng.choice([0, 66]) for _ in range(max(rng.randint(0, 4), 4 - len(left))))
        text = left + lead + right
        parts.append(text)
        sizes.append(len(text))
        leads.append(len(left))
        want += [(len(left) - i, text[i : i + length]) for i in range(len(text) - length + 1)]
    starts = np.cumsum([0, *sizes[:-1]])
    got = equal_strings(np.frombuffer(b"".join(parts), np.uint8), starts, np.array(sizes), np.array(leads), length)
    assert len(got) == len(want)
    for (x, a), (y, b) in itertools.combinations(zip(want, got.tolist()), 2):
        assert (x == y) == (a == b)


def test_long_text_and_many_leads(spark):
    """One very long text that repeats itself, and more surroundings than are sorted at once."""
    rng = random.Random(2)
    body = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, body, "s", "x"), (2, body[1000:200_000] + "!" + body[200_000:300_000], "s", "x"), (3, "".join(rng.choice("abcdefgh ") for _ in range(5000)), "s", "x")]
    got = {r.doc_id: (r.n_removed, len(r.spans)) for r in remove_repeated_bytes(docs(spark, rows), texts=False).collect()}
    assert got == {1: (299_000, 1), 2: (299_000, 2), 3: (0, 0)}


def test_dedup_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeated(none).count() == 0 and remove_repeated_bytes(none).count() == 0


# ---- repetition rules ----


def brute_quality(t):
    t = t or ""
    w = re.findall(SPACE, t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_counts(spark):
    rows = odd_rows(5) + [(900, "same line here\n" * 30, "s", "x"), (901, " ".join(str(i) for i in range(200)), "s", "x")]
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in repetition(docs(spark, rows)).collect()], key=str)
    want = []
    for i, t, *_ in rows:
        q = brute_quality(t)
        base = q[0] < 50 or 100 * q[4] > 50 * q[0]
        want.append((i, *q, base))
    assert [g[:-1] for g in got] == sorted(want, key=str)
    kept = {g[0]: g[-1] for g in got}
    assert kept[901] and not kept[900] and not any(g[-1] and g[-2] for g in got)


def brute_shares(t, sizes):
    """Word characters in repeated n-grams by n, and in later copies of lines."""
    w = re.findall(SPACE, t or "")
    out = []
    for n in sizes:
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append(sum(len(w[j]) for j in hit))
    seen, lines = set(), 0
    for line in (t or "").split("\n"):
        chars = sum(map(len, re.findall(SPACE, line)))
        if chars:
            lines += chars * (line in seen)
            seen.add(line)
    return out, lines


def test_quality_verdict(spark):
    rows = odd_rows(6, 120) + [(800 + k, " ".join(random.Random(k).choice("abcdefgh") for _ in range(60 + 10 * k)), "s", "x") for k in range(20)] + [(900, "w " * 100_000, "s", "x"), (901, " ".join(map(str, range(100_000))), "s", "x")]
    got = {(r.doc_id, r.n_words): (list(r.dup_ngram_chars), r.dup_line_chars, r.kept) for r in repetition(docs(spark, rows)).collect()}
    for i, t, *_ in rows:
        shares, lines = brute_shares(t, range(5, 11))
        q = brute_quality(t)
        failed = any(s > limit * q[1] for s, limit in zip(shares, NGRAM_LIMITS.values())) or lines > LINE_LIMIT * q[1]
        assert got[i, q[0]] == (shares, lines, not (failed or q[0] < 50 or 100 * q[4] > 50 * q[0]))
    assert repetition(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunks_do_not_change_counts():
    texts = [t or "" for _, t, *_ in odd_rows(9)]
    one = [measure(b, o, (5,)) for _, _, b, o in tx.chunks(pa.array(texts), 1 << 20)]
    many = [measure(b, o, (5,)) for _, _, b, o in tx.chunks(pa.array(texts), 64)]
    for k in ("n_words", "n_repeat_words", "n_dup_lines", "word_chars", "dup_line_chars"):
        assert np.concatenate([x[k] for x in one]).tolist() == np.concatenate([x[k] for x in many]).tolist()


# ---- licences ----


def test_license_digest(spark):
    shout = "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace(",", " ;").replace("MERCHANTABILITY", "MERCHANTIBILITY")
    rows = [(1, shout, "s", "x"), (2, MIT + " and more", "s", "x"), (3, None, "s", "x"), (4, "", "s", "x"), (5, "licensed under cc by-nc 4.0", "s", "x"), (5, "licensed under cc by-nc 4.0", "s", "x")]
    for limit in (100_000, 1):
        got = sorted(((r.doc_id, r.license) for r in scan_licenses(docs(spark, rows), known_licenses(spark), broadcast_rows=limit).collect()), key=str)
        assert got == [(1, "MIT"), (2, None), (3, None), (4, None), (5, "CC-BY-NC-4.0 (line)"), (5, "CC-BY-NC-4.0 (line)")]
    assert scan_licenses(docs(spark, rows), known_licenses(spark, {})).where("license is not null").count() == 0
    assert len(KNOWN) >= 10


# ---- token store ----


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_segments_encode_as_whole_texts(vocabulary):
    rng = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "é", "漢", "#", "'s", "'ll", " ", "\t", "\xa0", "　", "1", "²", ".", "<|endoftext|>", "ß", " x y", "\x00", "\x1c", "ab", "Zé", "'", ",", " é", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    e = Encoder(vocabulary)
    assert e.cuts and e.width == 2
    for i, j, buf, off in tx.chunks(pa.array(texts), 1 << 12):
        ids, bounds = e.encode(buf, off)
        for k in range(j - i):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == e.tok.encode(texts[i + k], add_special_tokens=False).ids


def test_shard_round_trip_and_lookup():
    w = ShardWriter(2)
    rows = [(None, [7]), *[(k * 3 - 50, list(range(k % 40))) for k in range(5000)], (10**12, [1, 2])]
    for k, ids in rows:
        w.add(key_of(k), np.array(ids, np.uint32))
    s = Shard(w.finish())
    assert [(k, ids.tolist()) for k, ids, _ in s] == [(key_of(k), ids) for k, ids in rows]
    assert len(s.blocks) > 1 and s.n_entries == len(rows) and s.n_ids == sum(len(i) for _, i in rows)
    assert s.get(100)[0].tolist() == rows[51][1] and s.get(101) == [] and s.get(None)[0].tolist() == [7]
    with pytest.raises(ValueError):
        Shard(b"short")


def test_bloom_hashes_are_independent():
    keys = [key_of(k) for k in range(20_000)]
    w = ShardWriter(2)
    for k in keys[:10_000]:
        w.add(k, np.zeros(1, np.uint32))
    shard = Shard(w.finish())
    assert all(shard.may_hold(k) for k in keys[:10_000])
    assert sum(shard.may_hold(k) for k in keys[10_000:]) < 150  # ten bits a key: 0.8 % in theory


def test_store_tokens(spark, vocabulary):
    rows = odd_rows(3)
    got = store_tokens(docs(spark, rows), vocabulary).collect()
    tok = Encoder(vocabulary).tok
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    assert store_tokens(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0
