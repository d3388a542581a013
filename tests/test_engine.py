"""Golden vectors and edge cases of the tokenizers, data set and tensor operators."""

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexloom import catalog
from lexloom.functions import textops as T
from lexloom.operators import bpe, dataset, pieces, tensor, unigram, vocab_store
from lexloom.sources import corpus

ENGLISH = " ".join(["low"] * 5 + ["lower"] * 2 + ["newest"] * 6 + ["widest"] * 3)
W = T.EOW


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def english(spark):
    return bpe.Bpe().train(docs(spark, ENGLISH))


def test_word_merges(english):
    assert english.merges == [("e", "s"), ("es", "t"), ("est", W), ("l", "o"), ("lo", "w"), ("n", "e"), ("ne", "w"), ("new", "est" + W), ("low", W), ("w", "i")]
    assert english.freqs == [9, 9, 9, 7, 7, 6, 6, 6, 5, 3]


def test_word_vocabulary(english):
    names = [r.token for r in english.vocabulary().orderBy("id").collect()]
    assert names == [T.UNK, "low" + W, "low", "e", "r", "newest" + W, "wi", "d", "est" + W, W]


@pytest.mark.parametrize("text,tokens", [("lower", ["low", "e", "r", W]), ("你好", ["你", W, "好", W]), ("", [])])
def test_tokenize(spark, english, text, tokens):
    rows = english.tokenize(docs(spark, text)).orderBy("pos").collect()
    assert [t for r in rows for t in r.tokens] == tokens


def test_fused_end_of_word(spark):
    model = bpe.Bpe().train(docs(spark, "hello world hello"))
    assert model.merges == [("h", "e"), ("he", "l"), ("hel", "l"), ("hell", "o"), ("hello", W)]
    vocabulary = model.vocabulary()
    ids = bpe.encode(model.tokenize(docs(spark, "hello")), vocabulary)
    assert ids.collect()[0].ids == [1]
    assert bpe.decode(ids, vocabulary).collect()[0].tokens == ["hello" + W]


def test_decode_unknown_id_raises(spark, english):
    with pytest.raises(PySparkException):
        bpe.decode(spark.createDataFrame([(0, [99])], "doc bigint, ids array<int>"), english.vocabulary()).collect()


def test_byte_merges(spark):
    model = bpe.Bpe("byte").train(docs(spark, ENGLISH))
    spell = lambda t: bytes.fromhex(t.replace(W, "")).decode() + W * t.endswith(W)
    assert len(model.merges) == 15
    assert sorted(spell(r.token) for r in model.vocabulary().where("id > 0").collect()) == sorted(w + W for w in ("low", "lower", "newest", "widest"))


@pytest.mark.parametrize("mode,tokens,text", [("word", ["low", "e", "r", W], "lower"), ("word", ["你", W, "好", W], "你好"), ("word", ["ab", W, "你", W], "ab你"), ("byte", ["E4", "BD", "A0", "E5", "A5", "BD", W], "你好"), ("word", [], "")])
def test_detokenize(spark, mode, tokens, text):
    row = spark.createDataFrame([(tokens,)], "tokens array<string>").select(bpe.detokenize(F.col("tokens"), mode).alias("t")).first()
    assert row.t == text


def test_merge_is_greedy_from_the_left(spark):
    row = spark.range(1).select(T.unwrap(bpe.merged(T.wrap(F.array(*[F.lit("a")] * 3)), "a", "a")).alias("t")).first()
    assert row.t == ["aa", "a"]


def test_words_are_parted_by_ascii_space_only(spark):
    assert [r.word for r in bpe.words(docs(spark, "a　b\tc")).collect()] == ["a　b", "c"]
    assert [r.word for r in bpe.words(docs(spark, "カー𠀀")).collect()] == ["カ", "ー", "𠀀"]


def test_no_pair_is_common_enough(spark):
    assert bpe.Bpe().train(docs(spark, "ab cd")).merges == []
    assert bpe.Bpe().train(docs(spark, "", None)).merges == []


def test_save_and_load(spark, english, tmp_path):
    vocab_store.save(english, f"file://{tmp_path}/tok")
    again, vocabulary = vocab_store.load(spark, f"file://{tmp_path}/tok")
    assert again.merges == english.merges
    assert {r.token: r.id for r in vocabulary.collect()} == {r.token: r.id for r in english.vocabulary().collect()}
    assert "low" in vocab_store.to_json(vocabulary).first().token_to_id


def test_read_texts_drops_invalid_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.txt").write_bytes(b"x\xffy")
    (tmp_path / "sub" / "c.txt").write_text("é")
    (tmp_path / "d.md").write_text("no")
    rows = corpus.read_texts(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["xy", "é"]


def test_unigram(spark):
    assert unigram.viterbi("abc", {"a": 1.0, "b": 1.0, "c": 1.0, "bc": 1.5}, 6) == ["a", "bc"]
    assert unigram.viterbi("axc", {"a": 1.0, "c": 1.0, "ac": 1.0}, 6) == ["a", "x", "c"]
    assert [r.sentence for r in unigram.sentences(docs(spark, "a　b\n\n x ")).orderBy("line").collect()] == ["▁a▁b", "▁x"]
    model = unigram.Unigram(vocab_size=20, em_steps=2).train(docs(spark, "low low lower"))
    assert "".join(t for r in model.tokenize(docs(spark, "lower low")).collect() for t in r.pieces) == "▁lower▁low"
    with pytest.raises(ValueError):
        unigram.Unigram().train(docs(spark, ""))


def test_windows_are_shifted(spark):
    stream = dataset.token_stream(spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4, 5])], "doc bigint, ids array<int>"))
    rows = dataset.windows(stream, dataset.strided_starts(stream, 2, 1), 2).orderBy("start").collect()
    assert [(r.x, r.y) for r in rows] == [([1, 2], [2, 3]), ([2, 3], [3, 4]), ([3, 4], [4, 5])]
    assert dataset.random_starts(5, 4, 3) == [0, 0, 0]
    with pytest.raises(ValueError):
        dataset.random_starts(4, 4, 1)


def test_top_k_keeps_ties(spark):
    rows = spark.createDataFrame([(0, 0, 3.0), (0, 1, 2.0), (0, 2, 2.0), (0, 3, 1.0)], "seq int, token int, logit double")
    assert sorted(r.token for r in tensor.top_k(rows, 2).collect()) == [0, 1, 2]


def test_clip_at_the_limit_changes_nothing(spark):
    row = spark.range(1).select(tensor.clip_scale(F.lit(1.0), 1.0).alias("a"), tensor.clip_scale(F.lit(2.0), 1.0).alias("b")).first()
    assert row.a == 1.0 and abs(row.b - 0.5) < 1e-6


@pytest.mark.parametrize("name", ["train_word_bpe_10", "vocab_word_bpe", "pair_stats_byte", "tokenize_word_bpe", "unigram_rescore", "windows_strided", "pretokenize_cjk"])
def test_query_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours = catalog.queries()[name](spark, sf_dir)
    columns = sorted(ours.columns)
    rows = lambda found: sorted(repr(tuple(r)) for r in found)
    theirs = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert rows([tuple(r) for r in ours.select(columns).collect()]) == rows(theirs)


def rows_as_sql(spark, tmp_path, name, vectors):
    """(our rows, those of the query's SQL) over embeddings made of ``vectors``, as texts, which tell the signs of zeros apart."""
    table = spark.createDataFrame([(i, v, i % 7) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    ours = catalog.queries()[name](spark, str(tmp_path))
    theirs = db.sql(f"SELECT {', '.join(ours.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(repr(tuple(r)) for r in ours.collect()), sorted(map(repr, theirs))


def test_rounding_is_that_of_sql(spark):
    draw = np.random.default_rng(2)
    values = [0.0, -0.0, 1.005, -1.005, 2.5e-5, 0.49999999999999994e-5, -4e-6, 1e300, -1e305, 1.5e308, float("inf"), float("-inf"), float("nan"), 0.285, 1.0e15 + 0.5, *(draw.integers(-10**8, 10**8, 2000) / 1e6 + 0.0), *draw.normal(0, 1e-5, 500)]
    db = duckdb.connect()
    for digits in (1, 4, 5, 6):
        ours = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(tensor.rounded(F.col("v"), digits).alias("v")).collect()
        theirs = db.execute(f"SELECT round(v, {digits}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [[float(v) for v in values]]).fetchall()
        assert [repr(r.v) for r in ours] == [repr(r[0]) for r in theirs]


def near_zero(count, scale):
    """Vectors whose results round to zero from either side."""
    return [[float(x) for x in row] for row in np.random.default_rng(3).normal(0, scale, (count, 64)).astype(np.float32)]


def test_adamw_keeps_the_sign_of_zero(spark, tmp_path):
    ours, theirs = rows_as_sql(spark, tmp_path, "adamw_step", near_zero(40, 3e-4))
    assert ours == theirs and "-0.0" in "".join(ours)


def test_grad_clip_keeps_the_sign_of_zero(spark, tmp_path):
    ours, theirs = rows_as_sql(spark, tmp_path, "grad_clip", [[1.5, *v[1:]] for v in near_zero(20, 1e-5)])
    assert ours == theirs and "-0.0" in "".join(ours)


@pytest.mark.parametrize("name", ["layer_norm", "linear_proj", "positional_add", "embedding_lookup"])
def test_tensor_queries_keep_the_sign_of_zero(spark, tmp_path, name):
    vectors = near_zero(64, 3e-6)
    if name == "layer_norm":  # a zero among large numbers of either sign
        vectors = [[1e-6, -1e-6, *(5.0 * (-1) ** i for i in range(62))] for _ in vectors]
    if name == "embedding_lookup":
        spark.createDataFrame([(0, "a bb ccc")], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
        ours = catalog.queries()[name]
        spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
        assert all("-0.0" in repr(r.y) for r in ours(spark, str(tmp_path)).collect())
        return
    ours, theirs = rows_as_sql(spark, tmp_path, name, vectors)
    assert ours == theirs and "-0.0" in "".join(ours)


@pytest.mark.parametrize("mode,alphabet", [("word", "ab"), ("word", "abcdé你"), ("byte", "abé")])
def test_training_from_pieces_of_words(spark, monkeypatch, mode, alphabet):
    draw = np.random.default_rng(len(alphabet))
    words = ["".join(draw.choice(list(alphabet), draw.integers(1, 9))) for _ in range(150)]
    table = docs(spark, *(" ".join(words[i] for i in (draw.zipf(1.3, 80) - 1) % 150) for _ in range(12)))
    whole = bpe.Bpe(mode, num_merges=40).train(table)
    monkeypatch.setattr(bpe.Bpe, "_learn_there", None)  # not even once an aggregation a round
    monkeypatch.setattr(bpe.Bpe, "_learn_here", None)  # nor all words on the driver
    sizes, symbols = [], pieces.symbols
    monkeypatch.setattr(pieces, "symbols", lambda *given: sizes.append(symbols(*given)) or sizes[-1])
    parts = bpe.Bpe(mode, num_merges=40, local_words=30).train(table)
    assert (parts.merges, parts.freqs) == (whole.merges, whole.freqs) and len(whole.merges) > 10
    assert all(len(s.tokens) <= 30 * bpe.SYMBOLS for s in sizes)
    assert {tuple(r) for r in parts.vocabulary().collect()} == {tuple(r) for r in whole.vocabulary().collect()}


def test_ends_of_one_spelling():
    ends = pieces.Ends(["a", "b", "c", "bc", "abc"])
    assert [ends(*p) for p in [("a", "b"), ("ab", "c"), ("b", "c"), ("c", "a"), ("ca", "b")]] == [False, True, True, False, False]
