"""WARC, language identification, the n-gram join and the pipeline."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import warc
from weft.llm.language import identify, rejection_bounds, train
from weft.llm.mixing import mix_sources
from weft.llm.nearjoin import DEPTH, TREES, drop_near_duplicates, forest_links, labels, matched, near_duplicates, pilot_recall, recall_of, shortened

# ---- WARC ----


def test_records_round_trip():
    data = warc.record("response", [("WARC-Record-ID", "<a>")], b"x" * 100_000) + warc.record("metadata", [("WARC-Record-ID", "<b>")], b"\r\n\r\n")
    got = list(warc.records(data))
    assert [(h["warc-type"], len(b)) for h, b in got] == [("response", 100_000), ("metadata", 4)]
    with pytest.raises(ValueError):
        list(warc.records(data[:-4]))


def test_captures(spark):
    rows = [(1, "http://a/", "one", 9), (2, "http://b/", "one", 9), (3, None, "two", 9), (4, "http://c/\nx", None, 9), (5, "http://d/", "", 9), (6, "http://e/", "é\r\n\r\nü", 9), (2, "http://b/", "one", 9), (None, "http://f/", "one", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id int").repartition(3)
    got = warc.archive_and_assemble(pages).collect()
    field = lambda r, n: r.metadata.fields.get(n)
    out = sorted([(field(r, "page-id"), r.response.kind, r.response.payload_bytes, r.response.payload_digest, field(r, "refers-to-page")) for r in got], key=str)
    digest = lambda t: warc.digest_of(t.encode())
    want = [("1", "revisit", 3, digest("one"), "2"), ("2", "response", 3, digest("one"), None), ("2", "response", 3, digest("one"), None), ("3", "response", 3, digest("two"), None), ("4", "revisit", 0, digest(""), "5"), ("5", "response", 0, digest(""), None), ("6", "response", 8, digest("é\r\n\r\nü"), None), (None, "revisit", 3, digest("one"), "2")]
    assert out == sorted(want, key=str)
    assert all(r.request.concurrent_to == r.response.record_id and r.metadata.concurrent_to == r.request.record_id for r in got)
    assert {bytes(r.response.payload) for r in got if r.response.kind == "response"} == {b"one", b"two", b"", "é\r\n\r\nü".encode()}
    small = warc.archive_and_assemble(pages, min_revisit=4).collect()
    assert {r.response.kind for r in small} == {"response"}


def test_captures_of_nothing_and_strays(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_assemble(none).count() == 0
    stray = spark.createDataFrame([("<m>", "metadata", "<gone>"), ("<r>", "response", None)], "record_id string, kind string, concurrent_to string")
    got = warc.assemble(stray).collect()
    assert len(got) == 1 and got[0].metadata is None and got[0].request is None


def test_archives_are_read_once(spark):
    long = "x" * 3_000_000 + "é"
    pages = spark.createDataFrame([(1, "http://a/", long), (2, "http://b/", long), (3, "http://c/", "y")], "page_id long, url string, html string")
    got = warc.archive_and_assemble(pages, payloads=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {(r.response.kind, r.response.payload_bytes) for r in got.collect()} == {("response", 3_000_002), ("revisit", 3_000_002), ("response", 1)}


def test_records_are_led_through_another_record(spark):
    rows = [("<p>", "response", None), ("<q>", "request", "<p>"), ("<m>", "metadata", "<q>"), ("<m2>", "metadata", "<p>"), ("<p2>", "revisit", None), ("<q2>", "request", "<p2>"), (None, "metadata", None)]
    for parts in (1, 4):
        got = warc.assemble(spark.createDataFrame(rows, "record_id string, kind string, concurrent_to string").repartition(parts)).collect()
        assert {(r.capture_id, r.request.record_id, r.metadata and r.metadata.record_id) for r in got} == {("<p>", "<q>", "<m2>" if "<m2>" < "<m>" else "<m>"), ("<p2>", "<q2>", None)}


# ---- language ----


def sentences(seed, n):
    rng = random.Random(seed)
    words = {"en": "the of and thing with other house water time".split(), "de": "der die und nicht ein über straße haus wasser zeit".split(), "fr": "le la et être maison eau temps année où".split()}
    return [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60))), lang) for k, lang in enumerate(rng.choice(list(words)) for _ in range(n))]


def test_language_held_out_accuracy(spark):
    rows = sentences(1, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df.where("doc_id % 4 <> 2"), sample_key=F.col("doc_id"))
    got = identify(df.where("doc_id % 4 = 2").withColumnRenamed("lang", "score"), model).collect()
    truth = {k: lang for k, _, lang in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.98
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "漢字仮名交じり文" * 40), (5, "the"), (5, "the")], "doc_id long, text string")
    out = {(r.doc_id, r.lang_pred == "und", r.rejected) for r in identify(odd, model).collect()}
    assert out == {(1, True, True), (2, True, True), (3, True, True), (4, False, True), (5, False, False)}


def test_probabilities_sum_to_one(spark):
    """Each model is a distribution over the next character of any context."""
    from weft.llm.language import _score_grams

    df = spark.createDataFrame(sentences(3, 60), "doc_id long, text string, lang string")
    model = train(df, sample_key=F.col("doc_id"))
    alphabet = sorted(set("".join(r.text for r in df.collect())))
    context = [ord(c) for c in "the"]
    grams = np.array([[*context, ord(c)] for c in alphabet], np.uint32)
    total = np.exp2(-_score_grams(grams, model.models)).sum(0)
    assert np.all(total <= 1.0 + 1e-9) and np.all(total > 0.9)  # the rest is for unseen characters


def brute_kneser_ney(texts, order, alphabet):
    """p(gram) by the published recursion, in dictionaries of tuples."""
    pads = [(0x110000,) * (order - 1) + tuple(map(ord, " ".join(t.lower().split()))) for t in texts]
    grams = {n: Counter(p[k - n + 1 : k + 1] for p in pads for k in range(order - 1, len(p))) for n in range(1, order + 1)}
    counts = {order: grams[order]}
    for n in range(1, order):
        counts[n] = Counter(g[1:] for g in grams[n + 1])  # distinct left neighbours
    discount = {}
    for n, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
    total = {n: Counter() for n in counts}
    kinds = {n: Counter() for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1.0 / alphabet
        seen = total[n][gram[:-1]]
        low = p(gram[1:])
        return low if not seen else max(counts[n][gram] - discount[n], 0) / seen + discount[n] * kinds[n][gram[:-1]] / seen * low

    return p


def test_models_are_kneser_ney(spark):
    from weft.llm.language import ORDER, _score_grams

    rows = sentences(8, 90)
    # Calibration texts are held back by their hash; all others must be counted.
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, sample_key=F.col("doc_id"))
    held = {r.doc_id for r in df.where((F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)) < 0.1).collect()}
    used = [(t, lang) for k, t, lang in rows if k not in held]
    alphabet = len({c for t, _ in used for c in t}) + 1
    rng = np.random.default_rng(1)
    text = [0x110000] * 3 + [ord(c) for t, _ in used[:30] for c in t] + rng.integers(97, 123, 300).tolist()
    grams = np.array([text[k : k + ORDER] for k in range(len(text) - ORDER + 1)], np.uint32)
    got = np.exp2(-_score_grams(grams, model.models))
    for k, lang in enumerate(model.languages):
        p = brute_kneser_ney([t for t, own in used if own == lang], ORDER, alphabet)
        assert np.allclose(got[:, k], [p(tuple(g)) for g in grams.tolist()], rtol=1e-9)


def test_rejection_holds_against_bad_calibration_texts(spark):
    rng = np.random.default_rng(3)
    entropy, lengths = rng.normal(2.5, 0.1, 600), rng.integers(300, 3000, 600)
    clean = rejection_bounds(entropy, lengths, np.zeros(600, int), 2)
    entropy[:4] = 12.0  # texts with a wrong label
    bad = rejection_bounds(entropy, lengths, np.zeros(600, int), 2)
    assert clean.shape == bad.shape == (2, 32) and (bad[0] - clean[0]).max() < 0.5 and bad[0, 9] < 5
    assert (np.diff(bad[0]) <= 0).all()  # short texts have more room


def test_junk_is_rejected(spark):
    model = train(spark.createDataFrame(sentences(5, 600), "doc_id long, text string, lang string"), sample_key=F.col("doc_id"))
    rng = random.Random(4)
    junk = ["".join(rng.choice("qxzjkvw0123456789+/=") for _ in range(800)), "Съешь же ещё этих мягких французских булок " * 20, "0x3f 0x7a; mov eax, ebx; " * 40, "<div class='b7'><a href='/q?x=1'></a></div>" * 20]
    df = spark.createDataFrame(list(enumerate(junk)) + [(9, t) for _, t, _ in sentences(6, 40)], "doc_id long, text string")
    got = identify(df, model).collect()
    assert {r.doc_id for r in got if r.rejected} == {0, 1, 2, 3} and model.false_rejection <= 0.05


def test_identify_odd_tables(spark):
    model = train(spark.createDataFrame(sentences(5, 60), "doc_id long, text string, lang string"), sample_key=F.col("doc_id"))
    assert identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    long = " ".join(t for _, t, lang in sentences(7, 20_000) if lang == "en")
    assert len(long) > 1_000_000
    got = identify(spark.createDataFrame([("a", long, 1), ("a", long, 2)], "doc_id string, text string, lang_pred int"), model).collect()
    assert [(r.doc_id, r.lang_pred, r.rejected) for r in got] == [("a", "en", False)] * 2


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    model = train(df, sample_key=F.col("doc_id"))
    assert identify(df, model).first().lang_pred == "und"


# ---- n-gram join ----


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_join(rows, threshold=0.8):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= threshold * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
                if x != y:
                    links[a].add(y)
                    links[b].add(x)
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[find(k)] = min(least.get(find(k), (2,)), (i is not None, i or 0))
    return sorted([(i, (None if not least[find(k)][0] else least[find(k)][1]) if s else i, len(links[k])) for k, (i, s) in enumerate(sets)], key=str)


def near_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    return rows + [(100, None), (101, ""), (102, "one two"), (103, "One, two!"), (104, rows[0][1]), (104, rows[0][1]), (None, rows[1][1])]


@pytest.mark.parametrize("group_docs", [512, 4])
def test_near_duplicates_match_brute_force(spark, group_docs, monkeypatch):
    if group_docs == 4:  # texts by shuffle, too
        monkeypatch.setattr("weft.llm.nearjoin.BROADCAST_MEMBERS", 0)
    rows = near_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, group_docs=group_docs).collect()], key=str)
    assert got == brute_join(rows)


def test_one_of_each_class_stays(spark):
    rows = near_rows(2)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    classes = {(c, i if not shingles(t) else None) for (i, c, _), t in zip(brute_join(rows), [t for _, t in sorted(rows, key=lambda r: str((r[0],)))], strict=True)}
    assert kept.where("text is not null and text <> ''").count() == len({c for c, e in classes if e is None})
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefix_is_shortened_to_the_target_recall():
    perfect = [1.0] * DEPTH
    assert shortened(0.8, TREES, DEPTH, 0.999, perfect) == 8 and recall_of(0.8, TREES, 8) >= 0.999 > recall_of(0.8, TREES, 9)
    d = shortened(0.5, TREES, DEPTH, 0.999, perfect)
    assert d < 8 and recall_of(0.5, TREES, d) >= 0.999 > recall_of(0.5, TREES, d + 1)
    assert shortened(0.95, TREES, DEPTH, 0.999, perfect) == DEPTH  # nothing to shorten
    assert shortened(0.8, TREES, DEPTH, 0.999, [1.0] * 5 + [0.99] * (DEPTH - 5)) == 5  # pairs that hash worse than the formula says


def test_recall_is_measured_on_pairs_at_the_threshold(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts + [None, "", "one two"]], "text string")
    measured = pilot_recall(df, 1.0)
    assert measured == sorted(measured, reverse=True) and len(measured) == DEPTH
    assert all(abs(measured[d - 1] - recall_of(0.8, TREES, d)) < 0.08 for d in range(1, DEPTH + 1))
    assert pilot_recall(df, 0.0) == [1.0] * DEPTH


def test_links_are_matched_at_several_depths(spark):
    """Links of the tries against all prefixes of all labels, compared one by one."""
    rng = np.random.default_rng(5)
    trees, depth, stop = 6, 7, 3
    made = rng.integers(0, 3, (40, trees, depth)).astype(np.uint8)
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(made)], "class long, label binary").repartition(3)
    got = {(r.src, r.dst): r.matched for r in forest_links(df, trees, depth, stop).collect()}
    best = {(i, j): int(matched(made[i], made[j]).max()) for i in range(40) for j in range(40) if i != j}
    assert all(stop <= m <= best[p] for p, m in got.items()) and len(set(got.values())) > 2

    def groups(pairs):
        seen = list(range(40))
        for a, b in pairs:
            x, y = seen[a], seen[b]
            seen = [min(x, y) if v in (x, y) else v for v in seen]
        return seen

    assert groups(p for p, m in best.items() if m >= stop) == groups(got)
    one = {(r.src, r.dst): r.matched for r in forest_links(df.coalesce(1), trees, depth, stop).collect()}
    for at in range(stop, depth + 1):  # in one batch, at every length the links connect what shares a prefix of that length
        assert groups(p for p, m in best.items() if m >= at) == groups(p for p, m in one.items() if m >= at)


def test_labels_are_of_whole_sets():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    made = labels(np.concatenate([values, values]), np.array([0, 50, 50, 100]), 4, 5)
    assert made.shape == (2, 4, 5) and (made[0] == made[1]).all() and len(np.unique(made)) > 5


def test_near_duplicates_of_odd_tables(spark):
    long = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [("x1", long, 1), ("7", long + " more words at the end of it", 2), ("8", None, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, class long")
    got = {(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()}
    assert got == {(None, None, 1), (7, None, 1), (8, 8, 0)}  # identifiers that are no numbers are null, the least of a class


# ---- pipeline ----


#: Extra columns of documents, named like columns that stages make.
CLASHING = ["weft_key", "weft_row", "weft_node", "m_key", "k_node", "hit", "copies", "rows", "share", "copy", "id", "row", "size", "node", "rejected", "lang_pred", "a.b"]


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "no such words"), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    same = (5, "a b c d e f", "en", "s", 1)
    for docs, words in ((spark.createDataFrame([], schema), 0), (spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, long, "en", None, 1), *[same] * 5], schema), 60_000)):
        for name, stage in pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            if name == "token-ID / binary output":
                assert got.count() == docs.count()
            elif name == "mixing sources to target weights" and words:
                taken = [r.doc_id for r in got.collect()]
                # Of the five equal rows each is taken once or twice, as the source's target wants.
                mixed = mix_sources(pipeline._packed(docs, "text", "source"), id_col="weft_key")
                assert taken.count(5) == mixed.where("size = 6").agg(F.sum("copies")).first()[0] and taken.count(None) == taken.count(1) == 0
            elif not words:
                assert got.columns == docs.columns and got.count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rows = [(k, t, lang, f"s{k % 2}", len(t)) for k, t, lang in sentences(5, 120)]
    rows += [(1000 + k, rows[k][1], rows[k][2], "s0", 1) for k in range(5)] + [(2000, None, "en", "s1", 0), (2001, "漢字仮名交じり文" * 40, None, "s1", 1)]
    bench = [(1, " ".join(rows[7][1].split()[:10]))] if len(rows[7][1].split()) >= 10 else [(1, rows[7][1])]
    rows += [rows[9], rows[9]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.withColumns({c: F.lit(c) for c in CLASHING}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert ids["language ID"] == {r[0] for r in rows} - {2000, 2001}
    assert not ids["n-gram Jaccard join"] & set(range(1000, 1005))
    assert 7 not in ids["benchmark decontamination"]
    assert ids["token-ID / binary output"] == ids["mixing sources to target weights"] <= ids["benchmark decontamination"]
    assert seen["token-ID / binary output"].count() == seen["mixing sources to target weights"].count()
