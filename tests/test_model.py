"""The incremental trainer, the language model, the pre-trained adapter and the command line."""

import argparse

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom import catalog, cli
from lexloom.functions import textops as T
from lexloom.operators import bpe, dataset, gpt, merge_loop, pretrained, tensor

SF = "/root/testdata/sf0.001"


def recount(words, rounds, min_freq):
    """The merge loop by counting everything anew."""
    words, out = [(list(t), n) for t, n in words], []
    for _ in range(rounds):
        count = {}
        for tokens, n in words:
            for pair in zip(tokens, tokens[1:]):
                count[pair] = count.get(pair, 0) + n
        if not count or max(count.values()) < min_freq:
            break
        best = max(count, key=count.get)
        out.append((best, count[best]))
        words = [(merge_loop.merge_tokens(t, *best), n) for t, n in words]
    return out, [t for t, _ in words]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 4)), max_size=12), st.integers(0, 15))
def test_incremental_counts_match_recounting(words, rounds):
    words = [([*w, T.EOW], n) for w, n in dict(words).items()]
    found = merge_loop.learn(words, rounds, 2)
    expected, state = recount(words, rounds, 2)
    assert found == expected
    ranks = {}
    for n, (pair, _) in enumerate(found):
        ranks.setdefault(pair, []).append(n)
    assert [merge_loop.apply_rounds(t, ranks) for t, _ in words] == state


@pytest.mark.parametrize("mode", ["word", "byte"])
def test_both_trainers_agree(spark, mode):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    here = bpe.Bpe(mode, num_merges=20).train(items, "item_id")
    there = bpe.Bpe(mode, num_merges=20, local_words=0).train(items, "item_id")
    assert (here.merges, here.freqs) == (there.merges, there.freqs) and len(here.merges) == 20
    rows = lambda m: sorted(map(tuple, m.vocabulary().collect()))
    assert rows(here) == rows(there)


def test_long_merge_lists_match_the_expression(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    merges = bpe.Bpe(num_merges=30).train(items, "item_id").merges
    s = bpe.with_tokens(bpe.word_counts(items, key="item_id"))
    step = F.col("s")
    for pair in merges:
        step = bpe.merged(step, *pair)
    assert s.where(step != bpe.apply_merges(F.col("s"), merges)).count() == 0
    assert spark.sql("SELECT '' AS s UNION ALL SELECT NULL").select(bpe.apply_merges(F.col("s"), merges).alias("s")).where("s <> ''").count() == 0


@pytest.mark.parametrize("mode", ["word", "byte"])
def test_encoding_without_a_shuffle_matches_the_join(spark, mode):
    rows = spark.createDataFrame([(0, "low 你好 lower"), (1, ""), (2, None), (3, "zß x low"), (4, " \n")], "doc_id bigint, text string")
    model = bpe.Bpe(mode, num_merges=4).train(rows)
    vocabulary = model.vocabulary()
    expected = {r.doc: r.ids for r in bpe.encode(model.tokenize(rows), vocabulary).collect()}
    assert {r.doc: r.ids for r in model.encode(rows, vocabulary).collect()} == expected and expected.keys() == {0, 3}


def small(dropout=0.0):
    config = gpt.Config(11, 6, 2, 2, 8, dropout)
    return config, {k: w.astype(np.float64) for k, w in gpt.init(config).items()}


def test_gradients_match_finite_differences():
    config, w = small()
    rng = np.random.RandomState(0)
    x, y = rng.randint(0, 11, (3, 6)), rng.randint(0, 11, (3, 6))
    grads = gpt.Pass(config, w, x).gradients(y)
    assert grads.keys() == w.keys()
    for name in w:
        flat, g = w[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.randint(0, flat.size, 3):
            old, sides = flat[i], []
            for by in (1e-5, -1e-5):
                flat[i] = old + by
                sides.append(gpt.Pass(config, w, x).losses(y).mean())
            flat[i] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - g[i]) < 1e-6, name


def test_dropout_gradients():
    config, w = small(0.3)
    x = np.arange(6)[None] % 11
    loss = lambda: gpt.Pass(config, w, x, np.random.RandomState(5)).losses(x).mean()
    g = gpt.Pass(config, w, x, np.random.RandomState(5)).gradients(x)["0.q.w"]
    w["0.q.w"][1, 2] += 1e-5
    up = loss()
    w["0.q.w"][1, 2] -= 2e-5
    assert abs((up - loss()) / 2e-5 - g[1, 2]) < 1e-6


def test_later_tokens_do_not_change_earlier_logits():
    model = gpt.Gpt(gpt.Config(11, 6, 2, 2, 8))
    a, b = np.array([[1, 2, 3, 4]]), np.array([[1, 2, 9, 9]])
    assert np.allclose(model.logits(a)[:, :2], model.logits(b)[:, :2], atol=1e-6)
    assert model.size() == 2 * 11 * 8 + 6 * 8 + 2 * (12 * 64 + 13 * 8) + 16
    with pytest.raises(ValueError):
        model.logits(np.zeros((1, 7), int))
    with pytest.raises(ValueError):
        gpt.Config(n_embd=10, n_head=4)


def test_forward_is_made_of_the_column_operators(spark):
    config, w = gpt.Config(5, 3, 0, 1, 4), gpt.init(gpt.Config(5, 3, 0, 1, 4))
    rows = lambda m: F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in m])
    x = w["tok"][2] + w["pos"][0]
    column = tensor.linear(tensor.layer_norm(F.array(*[F.lit(float(v)) for v in x])), rows(w["head"]))
    assert np.allclose(spark.range(1).select(column.alias("y")).first().y, gpt.Pass(config, w, np.array([[2]])).logits[0, 0], atol=1e-5)
    up, down = np.random.RandomState(1).randn(6, 4), np.random.RandomState(2).randn(4, 6)
    z = up @ x
    erf, _ = gpt._erf_parts(z)
    column = tensor.feed_forward(F.array(*[F.lit(float(v)) for v in x]), rows(up), rows(down))
    assert np.allclose(spark.range(1).select(column.alias("y")).first().y, down @ (z * 0.5 * (1 + erf)), atol=1e-6)


def test_clip_and_top_k():
    g = {"a": np.array([3.0]), "b": np.array([4.0])}
    assert gpt.clip(g, 5.0) == 5.0 and g["a"][0] == 3.0
    gpt.clip(g, 1.0)
    assert abs(np.hypot(g["a"][0], g["b"][0]) - 1) < 1e-6
    assert np.isfinite(gpt.filter_top(np.array([3.0, 2.0, 2.0, 1.0]), 2)).tolist() == [True, True, True, False]


def stream_of(spark, ids):
    return dataset.token_stream(spark.createDataFrame([(0, ids)], "doc bigint, ids array<int>"))


def test_training_lowers_the_loss(spark):
    ids = [0, 1, 2, 3, 4] * 40
    heard = []
    trainer = gpt.Trainer(gpt.Gpt(gpt.Config(5, 8, 1, 2, 16, 0.1)), gpt.Training(8, 1e-2, 0.01, 80)).train(stream_of(spark, ids), len(ids), lambda n, loss: heard.append(n))
    assert heard == list(range(80)) and trainer.history[-1] < 0.3 < trainer.history[0]
    model = trainer.model
    prompts = spark.createDataFrame([(1, [0, 1, 2]), (2, []), (3, list(range(5)) * 3), (4, None)], "doc bigint, ids array<int>")
    found = {r.doc: r.ids for r in model.generate(prompts.repartition(3), 4, top_k=1).collect()}
    assert found == {1: [0, 1, 2, 3, 4, 0, 1], 2: [], 3: list(range(5)) * 3 + [0, 1, 2, 3]}
    windows = dataset.windows(stream_of(spark, ids), dataset.strided_starts(stream_of(spark, ids), 8, 8), 8)
    assert all(r.loss < 1 for r in model.window_losses(windows, 4).collect())
    assert model.window_losses(windows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        next(gpt.batches(stream_of(spark, [1, 2]), 2, 8, gpt.Training()))


def test_batches_are_the_drawn_windows(spark):
    o = gpt.Training(4, max_iters=3, seed=9)
    starts = dataset.random_starts(50, 5, 12, 9)
    x = np.concatenate([x for x, y in gpt.batches(stream_of(spark, list(range(50))), 50, 5, o)])
    assert x[:, 0].tolist() == starts and (np.diff(x) == 1).all()


def test_pretrained(spark, tmp_path):
    path = public_tokenizers.path(catalog.PRETRAINED)
    model = pretrained.Pretrained(spark, path).train()
    rows = spark.createDataFrame([(0, "Low, lower 你好"), (1, ""), (2, None)], "doc_id int, text string")
    found = rows.select(model.tokenize(F.col("text")).alias("t"), model.decode(model.encode(F.col("text"))).alias("d")).collect()
    assert [r.d for r in found] == ["Low, lower 你好", "", None] and found[1].t == [] and found[2].t is None
    assert model.vocab_size() == 50257
    assert pretrained.resolve(path, "") == path
    with pytest.raises(FileNotFoundError):
        pretrained.resolve(None, str(tmp_path))
    row = spark.createDataFrame([(["a", "b "],)], "t array<string>").select(pretrained.detokenize(F.col("t")).alias("s")).first()
    assert row.s == "ab "


@pytest.mark.parametrize("kind", ["word", "byte", "pretrained"])
def test_command_line(spark, tmp_path, kind):
    (tmp_path / "a.txt").write_text("low lower newest widest " * 30)
    o = cli.parse(["-d", str(tmp_path), "-t", kind, "-m", "20", "-b", "8", "-l", "1", "-e", "16", "-B", "4", "-i", "5", "-p", "low", "--tokenizer-file", public_tokenizers.path(catalog.PRETRAINED)])
    trainer, text = cli.run(spark, o)
    assert len(trainer.history) == 5 and isinstance(text, str)
    assert "Training Loss" in cli.plot(trainer.history)
    (tmp_path / "a.txt").write_text(" ")
    with pytest.raises(ValueError):
        cli.run(spark, argparse.Namespace(**vars(o)))


@pytest.mark.parametrize("name", ["train_word_bpe_20", "positional_add", "embedding_lookup", "feed_forward", "multinomial_given_u", "apply_one_merge", "unigram_uniform_scores", "shifted_targets", "token_range", "pretrained_round_trip"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = catalog.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = db.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in ours.select(columns).collect()) == sorted(map(repr, theirs))
