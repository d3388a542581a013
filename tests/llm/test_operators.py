"""Every operator on a table with nulls, empty and very long texts, ties, repeated rows and clashing names."""

import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import attention, byte_bpe, bytesets, decontaminate, graph, line_dedup, lm_score, minhash, quality_classifier, quality_rules, queries, sharding, substring_dedup, suffix_dedup

RANKS = public_tokenizers.path(queries.RANKS)
CLASHING = ["node", "shard", "score", "body", "print", "_id", "_print", "_row_print", "row", "id", "body_print", "starts", "runs", "n_lines", "n_removed", "label", "kept", "chunk", "ids", "items"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(draw, n):
    return " ".join("".join(draw.choice(["an", "ber", "tho", "é", "ing", "ro"]) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    shared, base = prose(draw, 60), prose(draw, 120)
    near = [" ".join(w if draw.random() > 0.02 else "changed" for w in base.split()) for _ in range(6)]
    texts = ["", None, " \n\t ", "a", "a a a a a a a a a", base, base, *near, shared + " tail", "head " + shared, prose(draw, 20000), "x" * 900, "ab" * 400, "é" * 500]
    texts += ["\n".join(prose(draw, 6) for _ in range(5)) for _ in range(3)]
    texts += [texts[-1] + "\nnew line", "top\n" + texts[-2], "one\ntwo\nthree\none\ntwo\nthree"]
    texts += [prose(draw, 30) for _ in range(20)]
    return [(i, t, None if i % 7 == 0 else "en", "s" if i % 3 else None, len(t or ""), *CLASHING) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark, rows):
    """The rows, two of them again, and texts without an id."""
    more = [rows[5], rows[5], (None, rows[7][1], *rows[7][2:]), (None, None, *rows[7][2:])]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def test_byte_repeats(spark, docs, rows, empty):
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [found[r[0]] for r in rows] == brute.byte_repeats([r[1] for r in rows], 200)
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert suffix_dedup.remove_repeats(odd(spark, rows)).count() == len(rows) + 4


def test_frequent_minimum_is_dealt_by_strings(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[r[0]] for r in rows] == brute.byte_repeats([r[1] for r in rows], 200)


def test_suffix_sort():
    data = np.frombuffer(b"banana bandana banana bandana" + bytes(8), np.uint8)
    at = np.arange(20)
    order = suffix_dedup.SuffixSort(data, at, np.zeros(20, np.int64), 9).order
    text = data.tobytes()
    assert [text[i : i + 9] for i in at[order]] == sorted(text[i : i + 9] for i in at)


def test_suffix_sort_survives_collisions(monkeypatch):
    """With hashes that are all equal the order comes from the bytes."""
    draw = np.random.default_rng(2)
    data = np.concatenate([np.tile(draw.integers(97, 99, 50), 3), draw.integers(97, 99, 300), np.zeros(8)]).astype(np.uint8)
    at, segment = np.arange(400), np.arange(400) // 250
    want = suffix_dedup.SuffixSort(data, at, segment, 20)
    monkeypatch.setattr(suffix_dedup, "common", lambda hashes, a, b, limit: np.full(len(a), limit))
    got = suffix_dedup.SuffixSort(data, at, segment, 20)
    assert (got.repeats(segment) == want.repeats(segment)).all() and want.repeats(segment).any()
    text = data.tobytes()
    for k in (0, 1):
        assert [text[i : i + 20] for i in got.order if segment[i] == k] == sorted(text[i : i + 20] for i in at if segment[i] == k)


@pytest.mark.parametrize("many", [64, 0])
def test_word_repeats(spark, docs, rows, empty, monkeypatch, many):
    monkeypatch.setattr(substring_dedup, "MANY", many)
    found = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs).collect()}
    assert [found[r[0]] for r in rows] == brute.word_repeats([r[1] for r in rows], 35)
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(odd(spark, rows)).count() == len(rows) + 4


def thue_morse(n, swap=0):
    """A string and its complement collide in every polynomial hash modulo 2**64."""
    return "".join("ab"[bin(i).count("1") + swap & 1] for i in range(n))


def test_products_modulo_the_prime():
    draw, prime = np.random.default_rng(0), (1 << 61) - 1
    a, b = (np.append(draw.integers(0, prime, 500), [0, prime - 1, 1]).astype(np.uint64) for _ in range(2))
    assert bytesets.times(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b)]
    for values in (draw.integers(0, 256, 200_000).astype(np.uint8), draw.integers(0, 1 << 63, 200_000).astype(np.uint64)):
        values[150_000:150_300] = values[70:370]
        hashes = bytesets.Prefix(values, 1)
        assert hashes.windows(300)[70] == hashes.windows(300)[150_000] == hashes.ranges(np.array([70]), np.array([370]))[0] != hashes.windows(300)[71]


def test_structured_words_are_told_apart(spark):
    a, b = thue_morse(1024), thue_morse(1024, 1)
    rest = " ".join(f"w{i}" for i in range(34))
    texts = [a + " " + rest, b + " " + rest, a + " x y z", b + " x y z", a + " x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: tuple(r)[1:] for r in substring_dedup.remove_repeats(docs).collect()}
    assert [found[i] for i in range(5)] == brute.word_repeats(texts, 35) and found[0][1] == found[1][1] == 0
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()}
    assert near == brute.near_components(list(enumerate(texts)), 4, 80) and near[2][1] != near[3][1] == 3
    scored = {r.doc_id: r.n_known for r in lm_score.score(docs, F.col("doc_id") != 0, RANKS).collect()}
    assert scored[0] == 36 and scored[1] == 35 and scored[2] == 2 and scored[3] == 1
    benchmark = spark.createDataFrame([(0, " ".join([a, *(f"v{i} {a}" for i in range(12))]))], "item_id bigint, text string")
    held = {r.doc_id: r["items"] for r in decontaminate.contamination(spark.createDataFrame([(0, benchmark.first().text), (1, benchmark.first().text.replace(a, b))], "doc_id bigint, text string"), benchmark).collect()}
    assert held == {0: [0], 1: []}


@pytest.mark.parametrize("hot", [1000, 1])
def test_structured_bytes_are_told_apart(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    a, b, c = thue_morse(4096), thue_morse(4096, 1), prose(random.Random(6), 60)
    texts = [c + a, c + b, a + c, b[:2000], "q" * 30 + a[1024:2048], c[:199] + b]
    found = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == brute.byte_repeats(texts, 200)


def test_near_duplicates(spark, docs, rows, empty):
    want = brute.near_components([r[:2] for r in rows], 4, 80)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()}
    assert found == want
    assert minhash.near_duplicates(empty).count() == 0
    again = minhash.near_duplicates(odd(spark, rows), 4).collect()
    assert len(again) == len(rows) + 4
    assert all(r.kept == (r.doc_id == r.component_id) for r in again if r.doc_id is not None)
    assert sorted((r.n_shingles, r.kept) for r in again if r.doc_id is None)[0] == (0, True)


def test_large_groups_are_searched_in_pieces(spark, monkeypatch):
    """Copies that a long shared part brings into one bucket, in groups that their hub alone can't link."""
    monkeypatch.setattr(minhash, "SMALL", 200)
    monkeypatch.setattr(minhash, "STRIP", 300)
    draw = random.Random(11)
    shared, texts = prose(draw, 160).split(), []
    for _ in range(12):  # families: alike inside, at 0.7 or so between
        own = prose(draw, 30).split()
        for _ in range(3):
            words = [*shared, *own]
            words[draw.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert found == brute.near_components(rows, 4, 80)


def test_recall_of_near_duplicates(spark):
    """Every link of the documents at sf0.01, against all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets, where = {i: brute.shingles(t, 5) for i, t in rows}, {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    both = brute.Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert len(links) > 100 and sum(found[a] == found[b] for a, b in links) >= 0.99 * len(links)
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert all(top(i) == top(c) for i, c in found.items())  # nothing is linked without a path of links


@pytest.mark.parametrize("most", [500_000, 0])
def test_near_copies_under_null_and_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", most)
    draw = random.Random(10)
    near = lambda t, k: " ".join("changed" if i == k else w for i, w in enumerate(t.split()))
    a, b, c, d, e, f = (prose(draw, 150) for _ in range(6))
    table = [
        (None, a), (None, near(a, 0)), (None, near(a, 149)), (None, near(a, 0)),  # no id at all
        (None, b), (9, near(b, 0)), (1 << 62, near(b, 149)),  # without an id and with one
        (20, c), (20, d), (15, near(c, 0)), (30, near(d, 0)), (None, near(d, 149)),  # one id, two texts
        (None, e), (40, f), (None, "  "), (41, None),
    ]
    found = minhash.near_duplicates(spark.createDataFrame(table, "doc_id bigint, text string").repartition(3), 4)
    prints = {r.print: r.text for r in spark.createDataFrame(table, "doc_id bigint, text string").select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print")).collect()}
    rows = [(r.doc_id, prints[r.print] or "", r.component_id, r.kept) for r in found.collect()]
    assert len(rows) == len(table)
    of = lambda *texts: sorted({(i, x, k) for i, t, x, k in rows if t in texts}, key=str)
    assert len({t for i, t, x, k in rows if k and t in (a, near(a, 0), near(a, 149))}) == 1
    assert set(of(b, near(b, 0), near(b, 149))) == {(None, 9, False), (9, 9, True), (1 << 62, 9, False)}
    assert {(i, x, k) for i, x, k in of(c, d, near(c, 0), near(d, 0), near(d, 149))} == {(20, 15, False), (15, 15, True), (30, 15, False), (None, 15, False)}
    assert of(e) == [(None, None, True)] and of(f) == [(40, 40, True)] and of("  ") == [(None, None, True)] and of("") == [(41, 41, True)]


def test_sketch_fills_every_bin():
    table = minhash.sketches(np.array([7], np.uint64), np.array([1]), minhash.BINS)
    assert (table != minhash.EMPTY).all()
    draw = np.random.default_rng(0)
    a = draw.integers(0, 1 << 62, 1000).astype(np.uint64)
    both = minhash.sketches(np.concatenate([a[:900], a[100:]]), np.array([900, 900]), 512)
    assert abs((both[0] == both[1]).mean() - 0.8) < 0.08


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 21)], "u bigint, v bigint")
    assert {r.node: r.label for r in graph.components(edges).collect()} == {**dict.fromkeys(range(1, 10), 1), 20: 20, 21: 20}


def test_tokens(spark, docs, rows, empty):
    names = byte_bpe.read_ranks(RANKS)
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=names, special_tokens={})
    found = {r.doc_id: r for r in byte_bpe.round_trip(docs, RANKS).collect()}
    for i, text, *_ in rows:
        ids = theirs.encode_ordinary(text or "")
        assert (found[i].n_tokens, found[i].ids_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()))
        assert found[i].decoded_sha256 == brute.sha((text or "").encode())
    coded = byte_bpe.encode(docs, RANKS)
    assert {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode(coded, RANKS).collect()} == {r[0]: r[1] or "" for r in rows}
    one = coded.where("doc_id = 5").first()
    assert one.offsets[-1] == len(rows[5][1].encode()) and len(one.offsets) == len(one.ids) + 1
    assert byte_bpe.round_trip(empty, RANKS).count() == 0


def test_boundaries_follow_the_pattern():
    import regex

    draw, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    pieces = [*" \n\t'  srtevmlldaZé9½٣　  !?.-$", "'s", "'ll", "'re", "你好", "😀"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 80))) for _ in range(500)]
    data, offsets = bytesets.flat(pa.array(texts))
    marks = byte_bpe.boundaries(data, offsets, byte_bpe.code_classes())
    want = [offsets[i] + len(t[: m.start()].encode()) for i, t in enumerate(texts) for m in pattern.finditer(t)]
    assert marks.tolist() == [*want, len(data)]


def test_statistics_and_rules(spark, docs, rows, empty):
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, text, *_ in rows:
        n = brute.text_statistics(text)
        assert tuple(found[i])[1:6] == n
        assert found[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.judge(odd(spark, rows)).count() == len(rows) + 4
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}


def test_chi_square():
    assert abs(quality_rules.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


@pytest.mark.parametrize("groups", [20_000, 0])
def test_outliers_are_rejected(spark, monkeypatch, groups):
    monkeypatch.setattr(quality_rules, "MOST_GROUPS", groups)
    draw = random.Random(2)
    good = [(i, prose(draw, draw.randint(80, 200)), "en", "s") for i in range(300)]
    bad = [(300 + i, prose(draw, 100).replace(" ", " %% ").replace("a", "#"), "en", "s") for i in range(20)]
    found = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(found[i] for i in range(300)) and not any(found[i] for i in range(300, 320))


@pytest.mark.parametrize("groups", [20_000, 0])
def test_rules_against_brute_force(spark, monkeypatch, groups):
    monkeypatch.setattr(quality_rules, "MOST_GROUPS", groups)
    draw = random.Random(12)

    def text():
        kind = draw.random()
        body = prose(draw, int(math.exp(draw.gauss(4.5, 0.8))) + 2)
        if kind < 0.08:
            body = body.replace(" ", draw.choice([" # ", " % ", " <b> "]), draw.randint(1, 30))
        elif kind < 0.14:
            body = "\n".join([body[:40]] * draw.randint(2, 12)) + "\n" + body
        elif kind < 0.18:
            body = body.replace(" ", "")
        return body

    rows = [(draw.choice(["en", "en", "en", "de"]), draw.choice(["a", "a", "b", None]), text()) for _ in range(500)]
    rows += [("fr", "a", text()) for _ in range(20)] + [(None, None, t) for t in ("", None, "x")] + [rows[0]] * 2
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string")
    found = {r.doc_id: r.kept for r in quality_rules.judge(table.repartition(5)).collect()}
    want = brute.quality_kept(rows, quality_rules)
    assert [found[i] for i in range(len(rows))] == want and 10 < want.count(False) < 200
    again = quality_rules.judge(table.coalesce(1)).collect()
    assert {r.doc_id: r.kept for r in again} == found


def test_classifier(spark, docs, rows, empty):
    draw = random.Random(3)
    texts = [(i, prose(draw, 60) if i % 2 else "junk### *** %%% " * 12 + str(i)) for i in range(200)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    found = {r.doc_id: r for r in quality_classifier.score(table, labels).collect()}
    assert all(found[i].predicted == i % 2 and 0 <= found[i].score <= 1 for i in range(100, 200))
    assert quality_classifier.score(docs, labels).count() == len(rows)
    assert quality_classifier.score(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.score(table, labels.limit(0)).collect()} == {0.5}


def test_votes_against_brute_force():
    draw = np.random.default_rng(5)
    weighted, labels = draw.standard_normal((quality_classifier.TERMS, 8)).astype(np.float32), draw.integers(0, 2, 60).astype(float)
    voters = quality_classifier.Voters(weighted, np.zeros((0, 8)), labels)
    texts = [prose(random.Random(i), 40) for i in range(360)] + ["", "  "]
    facts = quality_classifier.term_counts(*bytesets.flat(pa.array(texts)))
    every = voters.latent(*facts)
    voters.vectors = every[:60]
    want = brute.nearest_votes(every.tolist(), every[:60].tolist(), labels.tolist(), quality_classifier.NEIGHBOURS, quality_classifier.SHARPNESS, voters.prior)
    assert voters.scores(*facts)[:360] == pytest.approx(want[:360], rel=1e-3, abs=1e-4)
    assert voters.scores(*facts)[360:].tolist() == [voters.prior] * 2
    again = brute.Counter(brute.WORD.findall(texts[0]))
    assert facts[2][(facts[0] == 0) & (facts[1] < quality_classifier.WORDS)].sum() == sum(again.values())


def test_held_out_quality(spark):
    """Area under the curve and accuracy on labelled rows that nothing was learned from."""
    sf_dir = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op2_quality_classifier(spark, sf_dir).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(rows) > 40 and area > 0.97 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95


def test_recall_of_decontamination(spark):
    """Against common subsequences at every place of every text at sf0.01."""
    sf_dir = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r.doc_id: set(r["items"]) for r in queries.op3_decontamination(spark, sf_dir).collect()}
    rule = (decontaminate.COPY, decontaminate.PARAPHRASE, decontaminate.ANSWER, decontaminate.ANSWER_SHARE)
    wanted = met = 0
    for i, text in texts.items():
        sure, maybe = brute.held_items(text, items, *rule)
        wanted, met = wanted + len(sure), met + len(sure & found[i])
        assert found[i] <= maybe, i
    assert wanted > 15 and met >= 0.95 * wanted


def test_decontamination_in_rounds(spark, monkeypatch):
    """Of a benchmark in many rounds each row comes out once, with the items of all rounds."""
    sf_dir = "/root/testdata/sf0.001"
    whole = {r.doc_id: r["items"] for r in queries.op3_decontamination(spark, sf_dir).collect()}
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2000)
    assert {r.doc_id: r["items"] for r in queries.op3_decontamination(spark, sf_dir).collect()} == whole and any(whole.values())


def test_decontamination(spark, docs, rows, empty):
    draw = random.Random(4)
    items = [(i, prose(draw, draw.randint(18, 50)).capitalize() + ".") for i in range(30)]
    altered = items[1][1].split()
    altered[3] = "other"
    texts = [(0, prose(draw, 200) + " " + items[0][1] + "\n" + prose(draw, 90)), (1, prose(draw, 40) + " " + " ".join(altered).upper().lower()), (2, prose(draw, 300)), (3, None), (4, ""), (None, items[2][1])]
    benchmark = spark.createDataFrame([*items, (30, None), (31, " ")], "item_id bigint, text string")
    found = {r.doc_id: r["items"] for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), benchmark).collect()}
    assert found == {0: [0], 1: [1], 2: [], 3: [], 4: [], None: [2]}
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, benchmark).count() == 0


def test_decontamination_of_few_passages(spark):
    """A corpus with fewer passages than the SVD has components gives the same items however it is dealt."""
    draw = random.Random(4)
    items = [(i, prose(draw, draw.randint(18, 50))) for i in range(30)]
    altered = items[1][1].split()
    altered[3] = "other"
    texts = [(0, prose(draw, 200) + " " + items[0][1] + "\n" + prose(draw, 90)), (1, prose(draw, 40) + " " + " ".join(altered)), (2, prose(draw, 300)), (3, items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    for parts in (1, 2, 3, 5):
        table = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(parts)
        assert {r.doc_id: r["items"] for r in decontaminate.contamination(table, benchmark).collect()} == {0: [0], 1: [1], 2: [], 3: [2]}, parts
    assert decontaminate.contamination(spark.createDataFrame(texts[2:3], "doc_id bigint, text string"), benchmark).count() == 1


def test_decontamination_by_items_of_any_length(spark):
    draw = random.Random(8)
    words = [prose(draw, 1) + str(i) for i in range(400)]  # few words, so that all of a text's are in the benchmark
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [some(n) for n in [3, 4, 5, 6, 8, 10, 11, 12, 64, 65, 141, 160, 200, 300, 600, 1000]]
    items += [some(40) for _ in range(40)]
    altered = [" ".join(w if k % 10 else "other" for k, w in enumerate(t.split(), 1)) for t in items]
    cut = items[15].split()[:500]
    texts = [some(draw.randint(0, 150)) + "\n" + t + " " + some(draw.randint(0, 150)) for t in items[:16]]
    texts += [some(70) + " " + t + " " + some(90) for t in altered[8:16]] + [" ".join(cut)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {r.doc_id: r["items"] for r in decontaminate.contamination(table, benchmark).collect()}
    assert found == {**{i: [i] for i in range(16)}, **{16 + i: [8 + i] for i in range(8)}, 24: []}


@pytest.mark.parametrize("cells", [1 << 27, 0])
def test_pieces_by_list_or_table(monkeypatch, cells):
    monkeypatch.setattr(decontaminate, "CELLS", cells)
    items = decontaminate.Items([7, 8], [" ".join(f"w{i}" for i in range(300)), "w1 w2 w3"])
    draw = np.random.default_rng(0)
    judge = decontaminate.Judge(items, draw.standard_normal((302, 16)).astype(np.float32), np.ones(302, np.float32))
    assert [a for i, a, _ in items.pieces] == [*range(0, 252, 24), 252] and len(judge.keyed) == 1
    ids = np.concatenate([np.zeros(50, np.int64), items.words[0], np.zeros(30, np.int64)])
    assert judge.found(ids, np.array([0, len(ids)])) == {0: {0: 1.0, 1: 1.0}}


def test_common_subsequence():
    item = np.array([1, 2, 3, 2, 5])
    assert decontaminate.common_subsequence(decontaminate.places(item), 5, [9, 2, 3, 9, 5, 1]) == 3


def test_language_model(spark, docs, rows, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = {r.doc_id: r for r in lm_score.score(docs, held, RANKS).collect()}
    tokens = {i: [*brute.WORD.findall((t or "").translate(brute.LOW)), None] for i, t, *_ in rows}
    counts = brute.Counter(t for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in tokens.items():
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert found[i].base_score == pytest.approx(base) and -1e9 < found[i].score < 0
    assert lm_score.score(empty, F.lit(False), RANKS).count() == 0


def test_subwords_with_and_without_the_library():
    names, draw = byte_bpe.read_ranks(RANKS), random.Random(15)
    words = [prose(draw, 1).encode() for _ in range(300)] + ["é你好".encode(), b"x" * 200, b"a", "\u3000".encode(), "b\u00a0c".encode()]
    fast, plain, small = (lm_score.Subwords(names) for _ in range(3))
    plain.merged, small.limit = lambda piece: byte_bpe.merge(piece, names), 20
    want = [np.array(byte_bpe.merge(b" " + w, names), "<u4").tobytes() for w in words]
    for cache in (fast, plain, small):
        assert [cache[w] for w in words] == want and [cache[w] for w in words] == want and len(cache) <= 400


def test_workers_use_one_blas_thread(spark):
    def run(batches):
        import time

        from lexloom.llm.threads import one_thread

        told = one_thread()
        for batch in batches:
            x = np.random.default_rng(0).standard_normal((1500, 1500))
            wall, cpu = time.perf_counter(), time.process_time()
            x @ x
            busy = (time.process_time() - cpu) / (time.perf_counter() - wall)
            yield pa.RecordBatch.from_arrays([pa.array([told]), pa.array([busy])], ["told", "busy"])

    found = spark.range(1, numPartitions=1).mapInArrow(run, "told boolean, busy double").first()
    assert not found.told or found.busy < 1.3


def test_counts_by_key():
    draw = np.random.default_rng(7)
    keys = np.unique(np.concatenate([draw.integers(0, 1 << 63, 3000).astype(np.uint64) * 2, np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(3, dtype=np.uint64)]))
    keys, counts = draw.permutation(keys), draw.integers(1, 1 << 40, len(keys))
    known, some = dict(zip(keys.tolist(), counts.tolist())), np.concatenate([keys, keys + np.uint64(1), keys[:0]])
    assert lm_score.Counts(keys, counts)(some).tolist() == [known.get(k, 0) for k in some.tolist()]
    assert lm_score.Counts(keys[:0], counts[:0])(some).sum() == 0 and len(lm_score.Counts(keys, counts)(keys[:0])) == 0


def test_drawn_rows_are_those_that_are_scored():
    draw = np.random.default_rng(6)
    ids, first = draw.integers(0, 90, 100), np.array([0, 7, 7, 60, 100])
    vocabulary, trainer = learned(ids, 90, 0)
    grid, opens, place = attention.rows_of(ids, first, vocabulary)
    slots = np.full(grid.size, -1)
    slots[place] = vocabulary.slots[ids]
    whole = {}
    for k, row in enumerate(grid):
        before = [] if opens[k] else grid[k - 1].tolist()
        whole[tuple(before), tuple(slots.reshape(grid.shape)[k])] = row.tolist()
    base = np.concatenate([[0], np.cumsum(-(-np.diff(first) // attention.STEP))])
    met = set()
    for _ in range(20):
        for inputs, known, target, counted in zip(*trainer.draw_rows(ids, first, base)):
            assert known[attention.STEP :].all() and known[: attention.STEP].all() == known[0]
            key = tuple(inputs[: attention.STEP][known[: attention.STEP]]), tuple(np.where(counted, target, -1))
            size = int(counted.sum())
            assert whole[key][:size] == inputs[attention.STEP :][:size].tolist()
            met.add(key)
    assert met == set(whole)


def test_attention_gradient():
    draw = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in attention.new_parameters().items()}
    for name in ("pair", "inside", "logit", "member"):
        p[name] = draw.standard_normal(p[name].shape) * 0.2
    inputs, target = draw.integers(0, 50, (2, 2 * attention.STEP)), draw.integers(0, 100, (2, attention.STEP))
    target[0, :4] = [attention.OWN, attention.OWN + 1, attention.OWN - 1, attention.OWN]
    known, counted = np.ones((2, 2 * attention.STEP), bool), draw.random((2, attention.STEP)) < 0.9
    known[0, : attention.STEP] = False
    loss = lambda: attention.loss_and_gradient(p, inputs, known, target, counted)
    g = loss()[1]
    assert set(g) == set(attention.SHAPES)
    for name in g:
        where = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = p[name][where], 1e-4
        p[name][where] = old + step
        up = loss()[0]
        p[name][where] = old - step
        down = loss()[0]
        p[name][where] = old
        assert (up - down) / (2 * step) == pytest.approx(g[name][where], rel=0.02, abs=1e-5), name


def learned(ids, n_ids, updates=300, opens=None):
    first = np.array([0, len(ids)])
    vocabulary = attention.Vocabulary(np.bincount(ids, minlength=n_ids), opens)
    trainer = attention.Trainer(attention.new_parameters(attention.pair_logits(attention.pair_counts(ids, first, vocabulary))), vocabulary)
    trainer.learn(ids, first, updates)
    return vocabulary, trainer


def test_attention_probabilities_add_up():
    ids = np.array([1, 2, 3, 4, 1, 2, 3, 9] * 30)
    vocabulary, trainer = learned(ids, 600)
    scorer = attention.Scorer(vocabulary, trainer.p)
    total = sum(np.exp(scorer.logs(np.array([1, 2, last]), np.array([0, 3]))[0][2]) for last in range(600))
    assert total == pytest.approx(1, abs=1e-3) and trainer.losses[-1] < trainer.losses[0] * 0.8


def test_probabilities_of_many_ids_add_up():
    """Own outputs, both rests, and the chance that an id opens a word."""
    draw = np.random.default_rng(8)
    ids, opens = draw.integers(0, 3000, 5000), np.arange(5000) % 4 == 0
    vocabulary, trainer = learned(ids, 5000, 20, opens)
    assert len(set(vocabulary.slots[vocabulary.slots < attention.OWN].tolist())) == attention.OWN - attention.MEMBERS
    every = np.stack([np.full(5000, 5), np.full(5000, 9), np.arange(5000)], 1).ravel()
    logs, opening = attention.Scorer(vocabulary, trainer.p).logs(every, np.arange(0, 15001, 3))
    share = np.exp(logs[2::3])
    assert share.sum() == pytest.approx(1, abs=2e-3) and share[opens].sum() == pytest.approx(np.exp(opening[2]), abs=2e-3)


def test_context_tells_250_ids_apart():
    ids = np.tile(np.arange(1, 251), 20)
    vocabulary, trainer = learned(ids, 600)
    scorer = attention.Scorer(vocabulary, trainer.p)
    last = lambda before: scorer.logs(np.array([before - 1, before, 250]), np.array([0, 3]))[0][2]
    assert last(249) > last(200) + np.log(10)


def test_attention_reaches_past_the_last_token():
    """What follows 7 depends on the token before it, which counted pairs can't tell."""
    draw = np.random.default_rng(3)
    ids = np.concatenate([[a, 7, 10 + a] for a in draw.integers(1, 5, 4000)])
    vocabulary, trainer = learned(ids, 600, 600)
    scorer = attention.Scorer(vocabulary, trainer.p)
    sure = [np.exp(scorer.logs(np.array([a, 7, 10 + a]), np.array([0, 3]))[0][2]) for a in range(1, 5)]
    assert min(sure) > 0.6


def test_windowed_scores_against_plain_attention():
    """Each token is scored once, by its own row and the row before it."""
    draw = np.random.default_rng(4)
    ids = np.append(draw.integers(0, 500, 140), [3000, 3001, 3002, 3500] * 2 + [1, 2])
    opens = np.arange(4000) % 3 == 0
    vocabulary, trainer = learned(ids, 4000, 50, opens)
    assert {attention.OWN, attention.OWN + 1} <= set(vocabulary.slots.tolist())
    p, step = trainer.p, attention.STEP
    p["near"] = draw.standard_normal(2 * step).astype(np.float32)
    first = np.array([0, 5, 5, 70, 150])
    logs, opening = attention.Scorer(vocabulary, p).logs(ids, first)
    for a, b in zip(first, first[1:]):
        before = [attention.INPUTS + 1, *vocabulary.inputs[ids[a : b - 1]]] if b > a else []
        x = p["embed"][before].astype(np.float64)
        for t in range(b - a):
            since = max(0, t // step * step - step)
            score = (x[since : t + 1] @ p["key"]) @ (x[t] @ p["query"]) / attention.WIDTH**0.5 + p["near"][t - np.arange(since, t + 1)]
            weight = np.exp(score - score.max())
            hidden = x[t] + weight / weight.sum() @ (x[since : t + 1] @ p["value"]) @ p["out"]
            share = attention.softmax(hidden @ p["logit"] + p["pair"][before[t]])
            slot = vocabulary.slots[ids[a + t]]
            kind = attention.class_of(slot)
            want = np.log(share[kind]) + vocabulary.inside[ids[a + t]]
            if slot < attention.OWN:
                want += np.log(attention.softmax(hidden @ p["member"][kind] + p["inside"][before[t], kind])[slot % attention.MEMBERS])
            assert logs[a + t] == pytest.approx(want, abs=2e-3)
            assert np.exp(opening[a + t]) == pytest.approx(share @ vocabulary.opening, abs=1e-3)


def test_word_chances_add_up_to_one_at_most(spark, rows):
    """Of all known words and the end after a context, and with the counted model's share of unknown ones."""
    draw = random.Random(14)
    names = byte_bpe.read_ranks(RANKS)
    texts = [" ".join(draw.choice(["an", "another", "and", "a", "the", "there", "therefore", "it", "item", "its"]) for _ in range(draw.randint(1, 40))) for _ in range(300)]
    cache, end = lm_score.subwords_of(RANKS, names), len(names)
    opens, blocks = lm_score.opening_ids(names), []

    def encoded(some):
        for _, _, part, starts, ends, first in lm_score.lowered(*bytesets.flat(pa.array(some))):
            yield lm_score.token_ids(part, starts, ends, first, cache, end)

    for ids, edge in encoded(texts):
        for a in range(0, len(texts), 50):
            part = edge[a : a + 51]
            blocks.append(([False] * (len(part) - 1), ids[part[0] : part[-1]].astype("<u2").tobytes(), np.diff(part).astype("<u4").tobytes()))
    junk = ([True] * 2, np.array([7, 8, 9], "<u2").tobytes(), np.array([1, 2], "<u4").tobytes())  # held out: not learned
    (vocabulary, p), tokens, n = lm_score.train(spark.createDataFrame([*blocks, junk], "held array<boolean>, ids binary, sizes binary").repartition(3), names, "<u2")
    assert (tokens, n) == (sum(len(t.split()) + 1 for t in texts), len(texts))
    scorer = attention.Scorer(vocabulary, p)
    known = sorted({w for t in texts for w in t.split()} | {f"{a}{b}" for a in ("an", "the", "it", "x", "zebra") for b in ("", "s", "ing", "q")})
    for context in ("", "the ", "an and the "):
        total = 0.0
        for word in [*known, None]:
            ids, edge = next(encoded([context + (word or "")]))
            heads, closes, keys = lm_score.tokens_of(ids, opens, end)
            assert len(heads) == len(keys) + 1 == len(context.split()) + (word is not None) + 1
            chance = lm_score.word_logs(*scorer.logs(ids, edge), heads, closes)
            total += np.exp(chance[len(context.split())])
        assert 0.8 < total <= 1.001, (context, total)


def test_line_runs(spark, docs, rows, empty):
    cut = line_dedup.remove_runs(docs)
    assert cut.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    found = {r.doc_id: r.text or "" for r in cut.collect()}
    assert [found[r[0]] for r in rows] == brute.kept_lines([r[:2] for r in rows], 3)
    assert line_dedup.remove_runs(empty).count() == 0
    assert line_dedup.remove_runs(odd(spark, rows)).count() == len(rows) + 4


def test_fewer_fingerprints_than_windows():
    lines = [prose(random.Random(i), 4) for i in range(1000)]
    texts = ["\n".join(lines[:700]), "\n".join(lines[700:]), "", "one", "one\ntwo"]
    data, offsets = bytesets.flat(pa.array(texts))
    hashes, text, pos, reach, h1, h2, counts, codes = line_dedup.fingerprints(data, offsets, 3, None)
    assert len(codes) == counts.sum() == 698 + 298 and len(hashes) < 0.7 * len(codes)
    assert set(reach.tolist()) <= {3, 4, 5} and (codes % 2).all() and set(text.tolist()) == {0, 1}
    copy = line_dedup.fingerprints(*bytesets.flat(pa.array(["\n".join(lines[100:400])])), 3, None)
    assert set(copy[0].tolist()) <= set(hashes.tolist())
    starts, ends, first = line_dedup.line_edges(*bytesets.flat(pa.array(["", "a\n", "", "\n\nb"])))
    assert first.tolist() == [0, 1, 3, 4, 7] and (ends - starts).tolist() == [0, 1, 0, 0, 0, 0, 1]


def test_passages_of_one_and_two_lines(spark, docs, rows):
    draw = random.Random(9)
    long, left, right, short = prose(draw, 50), prose(draw, 30), prose(draw, 20), prose(draw, 49)
    texts = [f"a\n{long}\nb\n{short}", f"c\n{long}\n{long}\nd", f"{left}\n{right}\ne", f"f\n{left}\n{right}", f"{short}\ng", short, "h\ni", "h\ni", "h", long, "", None, " \n ", " \n "]
    want = [texts[0], "c\nd", texts[2], "f", texts[4], "", "h\ni", "", "", "", "", "", " \n ", " \n "]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.text or "" for r in line_dedup.remove_runs(table, words=50).collect()} == dict(enumerate(want))

    assert {r.doc_id: r.text or "" for r in line_dedup.remove_runs(docs, words=50).collect()} == brute.kept_passages([r[:2] for r in rows], 3, 50)


def test_shards(spark, docs, rows, empty):
    found = sharding.shard_rows(docs).collect()
    by_shard: dict = {}
    for r in found:
        text = (rows[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 8)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard_rows(empty).count() == 0
    assert sharding.shard_rows(odd(spark, rows)).count() == len(rows) + 4


def test_shards_against_a_plain_descent(spark):
    tree = sharding.even_tree(8)
    names = {f"{path}" for region, rack, i, _ in sharding.grow(tree) for path in (f"/{region}", f"/{region}/{rack}", f"/{region}/{rack}/{i}")}
    keys = [str(i) for i in range(60)] + ["\x00null"]
    table = spark.createDataFrame([(n, k) for n in names for k in keys], "n string, k string").select("n", "k", F.xxhash64("n", "k").alias("h"))
    hashes = {(r.n, r.k): r.h % (1 << 64) for r in table.collect()}
    docs = spark.createDataFrame([(i, "x" * i) for i in range(60)] + [(None, "y")], "doc_id bigint, text string")
    for r in sharding.shard_rows(docs).collect():
        key = "\x00null" if r.doc_id is None else str(r.doc_id)
        draw = lambda name, k: hashes[name, k]
        assert r.shard == brute.tree_shard(draw, key, tree) and r.grown_shard == brute.tree_shard(draw, key, sharding.grow(tree))


def test_weights_are_kept_and_moves_are_confined(spark):
    keys = spark.range(20000)
    tree = [("a", "r", 0, 1.0), ("a", "q", 1, 2.0), ("b", "r", 2, 1.0)]
    heavier = [*tree[:2], ("b", "r", 2, 2.0)]
    moved = keys.select(sharding.tree_shard(F.col("id"), tree).alias("x"), sharding.tree_shard(F.col("id"), heavier).alias("y"))
    share = {r.x: r["count"] / 20000 for r in moved.groupBy("x").count().collect()}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[2] - 0.25) < 0.02
    assert moved.where("x <> y and y <> 2").count() == 0


def test_stages_on_odd_tables(spark, rows, empty):
    """Nulls, empty texts, repeated rows, an empty table and clashing names pass through every stage."""
    table = given = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
        after = spark.createDataFrame(stage(spark, table, "/root/testdata/sf0.001").collect(), given.schema)
        assert after.columns == given.columns and after.count() <= table.count(), name
        assert all(list(r[c] for c in CLASHING) == CLASHING for r in after.collect()), name
        alone = stage(spark, given, "/root/testdata/sf0.001").collect()
        texts = {(r.doc_id, r.text) for r in alone}
        if name == "quality rules":
            assert all(t and t.strip() for _, t in texts) and sum(r.doc_id == 5 for r in alone) in (0, 3)
        if name == "line dedup":
            assert len(alone) == len(rows) + 4 and {i for i, t in texts if t is None} == {1, None}
            assert all(r.n_chars == len(r.text or "") for r in alone if r.text != dict((x[0], x[1]) for x in rows).get(r.doc_id))
        if name in ("near duplicates", "benchmark decontamination"):
            assert {(0, ""), (1, None), (None, None)} <= texts
        table = after
    assert corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").count() == table.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "/root/testdata/sf0.001").count() == 0


def test_pipeline(spark):
    """The four stages that keep rows, and the encoding, against plain versions run one after another."""
    sf_dir = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = sorted(tuple(r) for r in given.collect())
    at = {c: given.columns.index(c) for c in given.columns}
    kept = brute.quality_kept([(r[at["lang"]], r[at["source"]], r[at["text"]]) for r in rows], quality_rules)
    plain = [list(r) for r, good in zip(rows, kept) if good]
    cut = brute.kept_passages([(r[0], r[at["text"]]) for r in plain], 3, queries.PASSAGE)
    for r in plain:
        if r[at["text"]] is not None and cut[r[0]] != r[at["text"]]:
            r[at["text"]], r[at["n_chars"]] = cut[r[0]], len(cut[r[0]])
    near = brute.near_components([(r[0], r[at["text"]]) for r in plain], 5, 80)
    plain = [r for r in plain if near[r[0]][1] == r[0]]
    rule = (decontaminate.COPY, decontaminate.PARAPHRASE, decontaminate.ANSWER, decontaminate.ANSWER_SHARE)
    plain = [r for r in plain if not brute.held_items(r[at["text"]], items, *rule)[0]]
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    want = {}
    for r in plain:
        ids = theirs.encode_ordinary(r[at["text"]] or "")
        want[r[0]] = (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha((r[at["text"]] or "").encode()))
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert found == want and 50 < len(found) < len(rows)


def test_attention_learns_from_every_row():
    vocabulary = attention.Vocabulary(np.ones(50))
    draw, seen = np.random.default_rng(5), []
    chunks = [(draw.integers(0, 50, 700), np.array([0, 0, 33, 300, 700])), (draw.integers(0, 50, 90), np.array([0, 17, 90]))]
    for part in range(4):
        trainer = attention.Trainer(attention.new_parameters(), vocabulary)
        trainer.step = lambda inputs, known, target, counted: seen.append((counted.sum(), len(counted)))
        for ids, first in chunks:
            trainer.learn_all(ids, first, 8, part, 4)
        assert trainer.read == sum(int((-(-np.diff(first) // attention.STEP)).sum()) for _, first in chunks)
    assert sum(n for n, _ in seen) == 790 and max(rows for _, rows in seen) == 8


def test_subwords_ask_once_for_each_word():
    """Words are told apart exactly, whatever bytes they hold, and each is looked up once in a block."""
    names, asked = byte_bpe.read_ranks(RANKS), []
    cache = lm_score.Subwords(names)

    class Asked(dict):
        def __getitem__(self, word):
            asked.append(word)
            return cache[word]

    kinds = [b"a", b"a\0", b"\0", b"\0\0", b"a" * 8, b"a" * 15, b"a" * 14 + b"\0", b"a" * 16, b"b" * 90, b"abcdefg\0", b"abcdefgh", b"abcdefgh\0", "你好".encode()]
    draw = random.Random(16)
    listed = [[draw.choice(kinds) for _ in range(n)] for n in (40, 0, 1, 300, 0)]
    texts = [b" ".join(x) for x in listed]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ids, edge = lm_score.token_ids(data, *bytesets.words(data, offsets), Asked(), len(names))
    want = [[*np.frombuffer(b"".join(cache[w] for w in x), "<u4").tolist(), len(names)] for x in listed]
    assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == want
    short = [w for w in asked if len(w) <= 15]
    assert len(short) == len(set(short)) and set(asked) == {w for x in listed for w in x}
    none = np.zeros(0, np.int64)
    assert lm_score.token_ids(data[:0], none, none, np.zeros(3, np.int64), cache, 9)[0].tolist() == [9, 9]


def plain_loss(p, inputs, known, target, counted):
    """Each place's cross-entropy, one by one."""
    total, step = 0.0, attention.STEP
    for row in range(len(inputs)):
        x = p["embed"][inputs[row]]
        for q in np.flatnonzero(counted[row]):
            sees = np.flatnonzero(known[row] & ~attention.FUTURE[q])
            score = (x[sees] @ p["key"]) @ (x[step + q] @ p["query"]) / attention.WIDTH**0.5 + p["near"][attention.DISTANCE[q, sees]]
            hidden = x[step + q] + attention.softmax(score) @ (x[sees] @ p["value"]) @ p["out"]
            before, slot = inputs[row, step + q], target[row, q]
            kind = attention.class_of(slot)
            total -= np.log(attention.softmax(hidden @ p["logit"] + p["pair"][before])[kind] + 1e-30)
            if slot < attention.OWN:
                total -= np.log(attention.softmax(hidden @ p["member"][kind] + p["inside"][before, kind])[slot % attention.MEMBERS] + 1e-30)
    return total / counted.sum()


@pytest.mark.parametrize("size", [1, 5])
def test_gradient_of_many_rows(size):
    """Rows of several blocks, inputs that recur and some that don't; size 5: scores and logits from which the largest has to be subtracted."""
    draw, n = np.random.default_rng(9), 2 * attention.BLOCK + 3
    p = {k: x.astype(np.float64) * size for k, x in attention.new_parameters().items()}
    for name in ("pair", "inside"):
        p[name] = -np.abs(draw.standard_normal(p[name].shape))
    p["near"] = draw.standard_normal(2 * attention.STEP)
    inputs, target = draw.integers(0, 60, (n, 2 * attention.STEP)) ** 2 % 1025, draw.integers(0, attention.OWN + 2, (n, attention.STEP))
    known, counted = np.ones((n, 2 * attention.STEP), bool), draw.random((n, attention.STEP)) < 0.9
    known[draw.random(n) < 0.3, : attention.STEP] = False
    loss, g = attention.loss_and_gradient(p, inputs, known, target, counted)
    assert loss == pytest.approx(plain_loss(p, inputs, known, target, counted), rel=1e-6)
    for name in g:
        way = g[name] / np.linalg.norm(g[name])
        up, down = (attention.loss_and_gradient(p | {name: p[name] + s * way}, inputs, known, target, counted)[0] for s in (1e-4, -1e-4))
        assert (up - down) / 2e-4 == pytest.approx(np.linalg.norm(g[name]), rel=0.01 if size == 1 else 0.1), name  # the loss, not its gradient, has a floor under tiny chances


def test_sums_by_input():
    draw = np.random.default_rng(10)
    for n, most in ((0, 5), (1, 5), (200, 3), (5000, 1025)):
        index = draw.integers(0, most, n)
        values = [np.append(draw.standard_normal((n, k)), np.zeros((1, k)), 0) for k in (16, 3)]
        for x, found in zip(values, attention.summed_by(index, values, most + 2)):
            want = np.zeros((most + 2, x.shape[1]))
            np.add.at(want, index, x[:-1])
            assert np.allclose(found, want)
