"""Tokenizer objects, vocabularies as JSON, data sets, settings, streams, and brute-force versions of what SQL can't express."""

import itertools
import json
import logging
import math
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexloom import catalog
from lexloom.functions import textops as T
from lexloom.operators import bpe, dataset, gpt, merge_loop, pretrained, tokenizer, unigram, vocab_store
from lexloom.plans import cut
from lexloom.streaming import encode as streams

SF = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


# -- marks in texts ----------------------------------------------------------------------------------
MARKED = "a\x02b a\x02b \x03\x03 \x01c\x01 a\x02b \x03\x03 \x01a \x01c\x01 plain plain"


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_marks_in_texts_are_symbols_like_any(spark, local):
    table = docs(spark, MARKED)
    model = bpe.Bpe(num_merges=30, local_words=local).train(table)
    other = {"\x01": "1", "\x02": "2", "\x03": "3"}
    same = lambda t: "".join(other.get(c, c) for c in t)
    want = bpe.Bpe(num_merges=30, local_words=local).train(docs(spark, same(MARKED)))
    assert [tuple(map(same, m)) for m in model.merges] == want.merges and model.freqs == want.freqs and len(want.merges) > 5
    vocabulary = model.vocabulary()
    assert [same(r.token) for r in vocabulary.orderBy("id").collect()] == [r.token for r in want.vocabulary().orderBy("id").collect()]
    ids = model.encode(table, vocabulary)
    assert ids.first().ids == want.encode(docs(spark, same(MARKED)), want.vocabulary()).first().ids
    assert bpe.encode(model.tokenize(table), vocabulary).first().ids == ids.first().ids
    plain = bpe.Bpe(merges=[])  # a token that was merged with end-of-word doesn't end a word
    tokens = [t for r in plain.tokenize(table).orderBy("pos").collect() for t in r.tokens]
    text = spark.createDataFrame([(tokens,)], "tokens array<string>").select(bpe.detokenize(F.col("tokens")).alias("t")).first().t
    assert text == MARKED


def test_escaping_goes_back_and_symbol_by_symbol():
    for size in range(5):
        for token in map("".join, itertools.product("\x01\x02\x03abc", repeat=size)):
            assert T.plain(T.escaped(token)) == token and not set(T.escaped(token)) & {"\x02", "\x03"}
            assert T.escaped(token) == "".join(map(T.escaped, token))


# -- vocabularies --------------------------------------------------------------------------------------
def test_json_vocabulary(spark, tmp_path):
    rows = [("<|unk|>", 0), ("b\"\\\n", 1), ("你", 2), ("\x02", 3), ("", 4)]
    vocab_store.save_json(spark.createDataFrame(rows, "token string, id int"), str(tmp_path / "v"))
    text = next((tmp_path / "v").glob("part-*")).read_text()
    assert json.loads(text)["token_to_id"] == dict(rows) and text.count("\n") > len(rows)
    assert {tuple(r) for r in vocab_store.load_json(spark, str(tmp_path / "v")).collect()} == set(rows)
    one = tmp_path / "other.json"
    one.write_text(json.dumps({"token_to_id": {"z": 9, "y": 4, "<|unk|>": 7}}, indent=2))
    assert {tuple(r) for r in vocab_store.load_json(spark, str(one)).collect()} == {("<|unk|>", 0), ("y", 1), ("z", 2)}
    one.write_text(json.dumps({"token_to_id": {"z": 3}}))
    assert {tuple(r) for r in vocab_store.load_json(spark, str(one)).collect()} == {("<|unk|>", 0), ("z", 1)}


# -- tokenizer objects ---------------------------------------------------------------------------------
class Words(tokenizer.Tokenizer):
    """What a user writes: whole words as tokens."""

    def train(self, docs, key="doc_id", text="text"):
        words = docs.select(F.explode(T.split_words(F.col(text))).alias("token")).distinct().withColumn("id", F.lit(1))
        self.vocabulary = bpe.renumber(words.union(self.spark.createDataFrame([(T.UNK, 0)], "token string, id int")))
        self.logger.info("trained")
        return self

    def tokenize(self, docs, key="doc_id", text="text"):
        return bpe.words(docs, "byte", key, text).withColumn("tokens", F.array("word"))

    def detokenize(self, tokens):
        return F.array_join(tokens, " ")


def test_base_class(spark, caplog):
    with pytest.raises(TypeError):
        tokenizer.Tokenizer(spark)
    mine = Words(spark, logging.getLogger("mine"))
    assert mine.vocab_size() == 1 and mine.encode(docs(spark, "a b")).first().ids == [0, 0]
    with caplog.at_level(logging.INFO, "mine"):
        mine.train(docs(spark, "b a c"))
    assert caplog.records[-1].name == "mine"
    assert mine.vocab_size() == 4
    ids = mine.encode(docs(spark, "c a x"))
    assert ids.first().ids == [3, 1, 0] and mine.decode(ids).first().text == "c a <|unk|>"


@pytest.mark.parametrize("mode", ["word", "byte"])
def test_bpe_object(spark, tmp_path, mode):
    table = docs(spark, "low low lower newest newest widest", "low newest")
    made = tokenizer.BpeTokenizer(spark, mode, num_merges=0)
    assert made.vocab_size() == 1
    made.train(table)
    assert {r.doc: r.text for r in made.decode(made.encode(table)).collect()} == {0: "low low lower newest newest widest", 1: "low newest"}
    fused = tokenizer.BpeTokenizer(spark, mode, num_merges=40).train(docs(spark, "low low", "low"))
    assert {r.doc: r.ids for r in fused.encode(docs(spark, "low low")).collect()} == {0: [1, 1]}
    assert fused.decode(fused.encode(docs(spark, "low low"))).first().text == "low<|w|>low<|w|>"  # a fused end-of-word stays
    made.save_vocab(str(tmp_path / "v"))
    again = tokenizer.BpeTokenizer(spark, mode).load_vocab(str(tmp_path / "v"))
    assert again.vocab_size() == made.vocab_size() and again.model.merges == []


def test_pretrained_object(spark):
    made = tokenizer.PretrainedTokenizer(spark, public_tokenizers.path(catalog.PRETRAINED))
    assert made.vocab_size() > 1000 and made.train(docs(spark, "x")) is made
    assert made.decode(made.encode(docs(spark, "low lower"))).first().text == "low lower"


def test_pretrained_follows_the_library(spark):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path(catalog.PRETRAINED))
    mine = pretrained.Pretrained(spark, public_tokenizers.path(catalog.PRETRAINED))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = table.select("text", mine.encode(F.col("text")).alias("ids")).collect()
    tokens = {r.doc_id: r.tokens for r in catalog.queries()["pretrained_tokenize"](spark, SF).collect()}
    for r in found:
        assert r.ids == theirs.encode(r.text).ids
    for r in table.collect():
        assert tokens[r.doc_id] == theirs.encode(r.text).tokens


# -- data sets -----------------------------------------------------------------------------------------
def test_text_dataset(spark, tmp_path):
    with pytest.raises(ValueError):
        dataset.TextDataset(Words(spark), text=" ", path="")
    words = [f"w{i:02d}" for i in range(40)]
    data = dataset.TextDataset(Words(spark), text=" ".join(words), block_size=8)
    assert len(data) == 40 and data[0:3] == [1, 2, 3] and data[-3:] == [38, 39, 40] and data[2:-36] == [3, 4] and data[:] == [*range(1, 41)] and data[50:60] == []
    assert sorted((r.start, r.x[0], r.y[-1]) for r in data.windows().collect()) == [(0, 1, 9), (8, 9, 17), (16, 17, 25), (24, 25, 33)]
    untrained = dataset.TextDataset(Words(spark), text="a b", auto_train=False)
    assert untrained[:] == [0, 0]
    known = Words(spark).train(docs(spark, "b a"))
    assert dataset.TextDataset(known, text="a b new")[:] == [1, 2, 0]  # what is trained isn't trained again
    (tmp_path / "x.txt").write_bytes(b"a \xff b")
    (tmp_path / "y.txt").write_text("c")
    assert dataset.TextDataset(Words(spark), path=str(tmp_path))[:] == [1, 2, 3]


def test_stream_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(dataset, "GROUP", 7)
    rows = [(i * 3 % 101, [i] * (i % 5)) for i in range(101)]
    found = dataset.token_stream(spark.createDataFrame(rows, "doc bigint, ids array<int>").repartition(5)).orderBy("pos").collect()
    want = [i for _, ids in sorted(rows) for i in ids]
    assert [r.id for r in found] == want and [r.pos for r in found] == [*range(len(want))]


# -- settings and folders ------------------------------------------------------------------------------
def test_settings_are_merged_deeply():
    o = gpt.Settings({"model": {"n_layer": 2}, "training": {"lr": 0.1}, "extra": {"a": {"b": 1}}})
    assert o.model["n_layer"] == 2 and o.model["n_embd"] == 256 and o["training"]["seed"] == 1337 and o["extra"] == {"a": {"b": 1}}
    assert o.config() == gpt.Config(n_layer=2) and o.schedule().lr == 0.1
    assert gpt.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": {"d": 3}}, "e": 4}) == {"a": {"b": {"d": 3}, "c": 2}, "e": 4}


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        cut.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert cut.shared_dir(Session()) == "hdfs://x/y"


# -- streams -------------------------------------------------------------------------------------------
def test_stream_is_encoded_like_a_batch(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = bpe.Bpe(num_merges=10).train(table)
    vocabulary = cut.cut(model.vocabulary())
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = table.randomSplit([0.5, 0.5], seed=1)
    for part in parts:
        part.write.mode("append").parquet(folder)
        streams.write_ids(streams.encode_stream(streams.read_documents(spark, folder, files_per_batch=1), model, vocabulary), out, checkpoint).awaitTermination()
    found = {r.doc: r.ids for r in spark.read.parquet(out).collect()}
    want = {r.doc: r.ids for r in model.encode(table, vocabulary).collect()}
    assert found == want and spark.read.parquet(out).count() == len(want)


# -- unigram -------------------------------------------------------------------------------------------
def cheapest(text, cost, longest):
    """Least cost over all ways to cut a text; none if no way exists."""
    best = None
    for marks in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        edges = [0, *(i + 1 for i, m in enumerate(marks) if m), len(text)]
        pieces = [text[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in cost and len(p) <= longest for p in pieces):
            total = sum(cost[p] for p in pieces)
            best = total if best is None else min(best, total)
    return best


def test_viterbi_against_all_segmentations():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("abc") for _ in range(draw.randint(1, 9)))
        cost = {"".join(p): draw.random() * 3 for n in (1, 2, 3, 4) for p in itertools.product("abc", repeat=n) if draw.random() < 0.4}
        pieces, want = unigram.viterbi(text, cost, 4), cheapest(text, cost, 4)
        assert "".join(pieces) == text
        assert pieces == list(text) if want is None else sum(cost[p] for p in pieces) == pytest.approx(want)


def test_unigram_training_against_plain_loops(spark):
    """Counts, Viterbi, prune and re-score in plain Python over the benchmark."""
    import re
    import unicodedata
    from collections import Counter

    rows = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())[:12]
    model = unigram.Unigram(vocab_size=120, em_steps=2).train(spark.createDataFrame(rows, "item_id bigint, text string"), "item_id")
    lines = [re.sub(r"\s+", " ", unicodedata.normalize("NFKC", line)).strip() for _, t in rows for line in t.split("\n")]
    lines = ["▁" + line.replace(" ", "▁") for line in lines if line]
    freq, first = Counter(), {}
    for n, line in enumerate(lines):
        for a in range(len(line)):
            for size in range(1, min(6, len(line) - a) + 1):
                freq[line[a : a + size]] += 1
                first.setdefault(line[a : a + size], (n, a, size))
    pieces = sorted(freq, key=lambda p: (len(p) > 1, 0 if len(p) == 1 else -freq[p], first[p]))[: 120 * 2]
    cost = dict.fromkeys(pieces, math.log(len(pieces)))
    for _ in range(2):
        used = Counter(p for line in lines for p in unigram.viterbi(line, cost, 6))
        place = {p: i for i, p in enumerate(pieces)}
        pieces = sorted(pieces, key=lambda p: (len(p) > 1, place[p] if len(p) == 1 else 0, -used[p], len(p), place[p]))[:120]
        total = sum(max(1, used[p]) for p in pieces)
        cost = {p: -math.log(max(1, used[p]) / total) for p in pieces}
    assert set(model.costs) == set(cost) and all(model.costs[p] == pytest.approx(cost[p]) for p in cost)


# -- first places --------------------------------------------------------------------------------------
def test_first_places_of_any_key(spark):
    rows = [((1 << 63) - 1, "x y"), (-(1 << 63), "z y"), (-3, "x"), (7, "x q"), (7, "p x")]
    counts = bpe.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = {r.word: (r.cnt, r.doc, r.pos) for r in counts.collect()}
    assert found == {"x": (4, -3, 0), "y": (2, -(1 << 63), 1), "z": (1, -(1 << 63), 0), "q": (1, 7, 1), "p": (1, 7, 0)}
    pairs = {(r.l, r.r): (r.freq, r.doc, r.pos, r.place) for r in bpe.pair_stats(bpe.with_tokens(counts)).collect()}
    assert pairs == {("x", T.EOW): (4, -3, 0, 0), ("y", T.EOW): (2, -(1 << 63), 1, 0), ("z", T.EOW): (1, -(1 << 63), 0, 0), ("q", T.EOW): (1, 7, 1, 0), ("p", T.EOW): (1, 7, 0, 0)}
    named = bpe.word_counts(spark.createDataFrame([("b", "x"), ("a", "y x")], "doc_id string, text string"))
    assert {r.word: (r.cnt, r.doc, r.pos) for r in named.collect()} == {"x": (2, "a", 1), "y": (1, "a", 0)}


@pytest.mark.parametrize("mode", ["word", "byte"])
def test_few_rounds_are_replaced_as_many_are_applied(mode, monkeypatch):
    """Words come apart alike by literal replacement and round by round, whatever marks and end-of-words they hold."""
    draw = random.Random(3)
    words = ["".join(draw.choice("aab\x01\x02\x03<|w>é") for _ in range(draw.randint(1, 9))) for _ in range(3000)] + ["<|w|>", "a\x03\x02b", "aaaa"]
    rounds = [p for p, _ in merge_loop.learn([(merge_loop.symbols_of(w, mode), 1) for w in words[::2]], 40, 2)] + ([("a\x03\x02a", "b"), ("a", "b")] if mode == "word" else [])
    few = merge_loop.segmenter(rounds, mode)
    monkeypatch.setattr(merge_loop, "FEW_ROUNDS", 0)
    many = merge_loop.segmenter(rounds, mode)
    assert [few(w) for w in words] == [many(w) for w in words]


def test_every_cjk_character_stands_alone(spark):
    """The class that is asked first leaves out no character of the four scripts."""
    rows = spark.range(0x110000 // 256).select(F.expr("concat_ws('', transform(filter(sequence(id * 256, id * 256 + 255), i -> i < 55296 or i > 57343), i -> decode(unhex(lpad(hex(i), 8, '0')), 'UTF-32')))").alias("t"))
    plain = F.regexp_replace("t", f"([{T.CJK}])", " $1 ")
    assert rows.where(T.isolate_cjk(F.col("t")) != plain).count() == 0 and rows.where(plain != F.col("t")).count() > 100


def test_encode_cuts_each_text_once(spark):
    """No text is cut into words below the exchange that deals it over the cores, nor by Spark at all."""
    model = bpe.Bpe(num_merges=3).train(docs(spark, MARKED))
    plan = model.encode(docs(spark, MARKED).repartition(2), model.vocabulary())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
