"""Registered queries of the engine's own operators, with the SQL that DuckDB runs for them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import textops as T
from lexloom.operators import bpe, dataset, gpt, pretrained, tensor, unigram, vocab_store
from lexloom.plans.cut import shared_dir
from lexloom.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- pieces of SQL ---------------------------------------------------------------------------------
CJK = r"\p{Han}\p{Katakana}\p{Hiragana}\p{Hangul}"
PLAIN = r"regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')"
WORDS = PLAIN.replace("text", rf"regexp_replace(text, '([{CJK}])', ' \1 ', 'g')")


def word_ctes(source: str, key: str, mode: str = "word") -> str:
    split = WORDS if mode == "word" else PLAIN
    symbols = "list_filter(string_split(word, ''), lambda c: c <> '')" if mode == "word" else "list_transform(range(1, strlen(word) + 1), lambda i: substr(hex(encode(word)), (2 * i - 1)::BIGINT, 2))"
    return f"""
each AS MATERIALIZED (SELECT {key} AS doc, unnest({split}) AS word, generate_subscripts({split}, 1) - 1 AS pos FROM {source}),
counts AS MATERIALIZED (SELECT word, count(*) AS cnt, min(struct_pack(doc := doc, pos := pos)) AS f FROM each GROUP BY word),
w0 AS MATERIALIZED (SELECT word, cnt, f.doc AS doc, f.pos AS pos, chr(57344) || array_to_string(list_append({symbols}, '<|w|>'), chr(57345) || chr(57344)) || chr(57345) AS s FROM counts)"""


def tokens_of(s: str) -> str:
    return f"list_filter(string_split(replace({s}, chr(57344), ''), chr(57345)), lambda t: t <> '')"


def pair_cte(state: str) -> str:
    return f"""SELECT l, r, sum(cnt)::BIGINT AS freq, min(struct_pack(doc := doc, pos := pos, place := place)) AS f FROM (
  SELECT cnt, doc, pos, k[i] AS l, k[i + 1] AS r, i - 1 AS place FROM (SELECT cnt, doc, pos, k, unnest(range(1, len(k))) AS i FROM (SELECT cnt, doc, pos, {tokens_of("s")} AS k FROM {state}))
) GROUP BY l, r"""


def trained_ctes(source: str, key: str, n: int, mode: str = "word") -> str:
    out = word_ctes(source, key, mode)
    for i in range(1, n + 1):
        out += f""",
b{i} AS MATERIALIZED (SELECT l, r, freq FROM ({pair_cte(f"w{i - 1}")}) ORDER BY freq DESC, f.doc, f.pos, f.place LIMIT 1),
w{i} AS MATERIALIZED (SELECT word, cnt, doc, pos, CASE WHEN freq >= 2 THEN replace(s, chr(57344) || l || chr(57345) || chr(57344) || r || chr(57345), chr(57344) || l || r || chr(57345)) ELSE s END AS s FROM w{i - 1}, b{i})"""
    return out


def vocab_ctes(n: int, mode: str = "word") -> str:
    skip = "WHERE t <> '<|w|>'" if mode == "word" else ""
    last = "UNION ALL SELECT '<|w|>', 0, struct_pack(doc := (SELECT max(doc) FROM w0), pos := 1073741824, place := 0)" if mode == "word" else ""
    return f"""
flat AS (SELECT cnt, doc, pos, unnest(k) AS t, generate_subscripts(k, 1) - 1 AS place FROM (SELECT cnt, doc, pos, {tokens_of("s")} AS k FROM w{n})),
seen AS (SELECT t AS token, sum(cnt)::BIGINT AS freq, min(struct_pack(doc := doc, pos := pos, place := place)) AS f FROM flat {skip} GROUP BY t {last}),
vocab AS MATERIALIZED (SELECT '<|unk|>' AS token, 0::BIGINT AS freq, 0 AS id UNION ALL SELECT token, freq, (row_number() OVER (ORDER BY f.doc, f.pos, f.place))::INT FROM seen)"""


def merge_rows(n: int) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS rank, l, r, l || r AS replacement, freq FROM b{i} WHERE freq >= 2" for i in range(1, n + 1))


ENCODED = f"""
tok AS (SELECT e.doc, e.pos, {tokens_of("w.s")} AS k FROM each e JOIN w{{n}} w USING (word)),
tk AS (SELECT doc, pos, unnest(k) AS token, generate_subscripts(k, 1) AS place FROM tok),
coded AS MATERIALIZED (SELECT doc, pos, place, coalesce(v.id, 0) AS id FROM tk LEFT JOIN vocab v USING (token))"""


def trained(spark, sf_dir, name="documents", n=10, mode="word", key="doc_id"):
    docs = table(spark, sf_dir, name)
    return bpe.Bpe(mode, num_merges=n).train(docs, key), docs


# -- sources and text ------------------------------------------------------------------------------
@query("SELECT count(*) AS file_count, (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS chars FROM documents")
def corpus_concat_stats(spark, sf_dir):
    return corpus.corpus_stats(table(spark, sf_dir, "documents"))


CJK_ROWS = [(0, "你好世界 ok"), (1, "a　b カー"), (2, "low 한글 x"), (3, "plain text"), (4, ""), (5, "𠀀x")]
CJK_VALUES = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in CJK_ROWS) + ") t(doc_id, text)"


@query(f"SELECT doc_id, regexp_replace(text, '([{CJK}])', ' \\1 ', 'g') AS spaced, {WORDS} AS words FROM {CJK_VALUES}")
def pretokenize_cjk(spark, sf_dir):
    rows = spark.createDataFrame(CJK_ROWS, "doc_id int, text string")
    spaced = T.isolate_cjk(F.col("text"))
    return rows.select("doc_id", spaced.alias("spaced"), T.split_words(spaced).alias("words"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+([{CJK}])', '\\1', 'g'), '([{CJK}])\\s+', '\\1', 'g') AS joined FROM {CJK_VALUES}")
def cjk_cleanup(spark, sf_dir):
    return spark.createDataFrame(CJK_ROWS, "doc_id int, text string").select("doc_id", T.join_cjk(F.col("text")).alias("joined"))


@query(f"WITH {word_ctes('documents', 'doc_id')} SELECT word, cnt, doc, pos::INT AS pos FROM w0")
def word_counts(spark, sf_dir):
    return bpe.word_counts(table(spark, sf_dir, "documents"))


@query(f"WITH {word_ctes('benchmark', 'item_id')} SELECT word, {tokens_of('s')} AS symbols FROM w0")
def symbol_split(spark, sf_dir):
    return bpe.with_tokens(bpe.word_counts(table(spark, sf_dir, "benchmark"), key="item_id")).select("word", T.unwrap(F.col("s")).alias("symbols"))


@query(f"WITH {word_ctes('benchmark', 'item_id', 'byte')} SELECT word, {tokens_of('s')} AS symbols FROM w0")
def byte_symbols(spark, sf_dir):
    return bpe.with_tokens(bpe.word_counts(table(spark, sf_dir, "benchmark"), "byte", key="item_id"), "byte").select("word", T.unwrap(F.col("s")).alias("symbols"))


FOLD = "trim(regexp_replace(regexp_replace(text, '(\\r?\\n)+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT conv_id, turn, CASE WHEN length({FOLD}) > 180 THEN left({FOLD}, 177) || '...' ELSE {FOLD} END AS summary FROM conversations")
def log_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.summary(F.col("text")).alias("summary"))


# -- byte pair encoding ----------------------------------------------------------------------------
@query(f"WITH {word_ctes('documents', 'doc_id')} SELECT l, r, freq, f.doc AS doc, f.pos::INT AS pos, f.place::INT AS place FROM ({pair_cte('w0')})")
def pair_stats_word(spark, sf_dir):
    return bpe.pair_stats(bpe.with_tokens(bpe.word_counts(table(spark, sf_dir, "documents"))))


@query(f"WITH {word_ctes('documents', 'doc_id', 'byte')} SELECT l, r, freq, f.doc AS doc, f.pos::INT AS pos, f.place::INT AS place FROM ({pair_cte('w0')})")
def pair_stats_byte(spark, sf_dir):
    return bpe.pair_stats(bpe.with_tokens(bpe.word_counts(table(spark, sf_dir, "documents"), "byte"), "byte"))


@query(f"WITH {trained_ctes('documents', 'doc_id', 1)} SELECT l, r, freq FROM b1")
def best_pair_word(spark, sf_dir):
    return bpe.best_pair(bpe.with_tokens(bpe.word_counts(table(spark, sf_dir, "documents")))).select("l", "r", "freq")


@query(f"WITH {trained_ctes('documents', 'doc_id', 10)} SELECT * FROM ({merge_rows(10)})")
def train_word_bpe_10(spark, sf_dir):
    return trained(spark, sf_dir)[0].merge_table(spark)


@query(f"WITH {trained_ctes('documents', 'doc_id', 10, 'byte')} SELECT * FROM ({merge_rows(10)})")
def train_byte_bpe_10(spark, sf_dir):
    return trained(spark, sf_dir, mode="byte")[0].merge_table(spark)


@query(f"WITH {trained_ctes('conversations', 'conv_id * 1000 + turn', 5)} SELECT rank, [l, r] AS pair, replacement FROM ({merge_rows(5)})")
def merges_serialized(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    return bpe.Bpe(num_merges=5).train(talk).merge_table(spark).select("rank", F.array("l", "r").alias("pair"), "replacement")


@query(f"WITH {trained_ctes('documents', 'doc_id', 10)}, {vocab_ctes(10)} SELECT * FROM vocab")
def vocab_word_bpe(spark, sf_dir):
    return trained(spark, sf_dir)[0].vocabulary()


@query(f"WITH {trained_ctes('documents', 'doc_id', 5, 'byte')}, {vocab_ctes(5, 'byte')} SELECT * FROM vocab")
def vocab_byte_bpe(spark, sf_dir):
    return trained(spark, sf_dir, n=5, mode="byte")[0].vocabulary()


@query(f"WITH {trained_ctes('benchmark', 'item_id', 10)} SELECT e.doc, e.pos::INT AS pos, e.word, {tokens_of('w.s')} AS tokens FROM each e JOIN w10 w USING (word)")
def tokenize_word_bpe(spark, sf_dir):
    model, docs = trained(spark, sf_dir, "benchmark", key="item_id")
    return model.tokenize(docs, "item_id")


@query(f"WITH {trained_ctes('documents', 'doc_id', 10)}, {vocab_ctes(10)}, {ENCODED.format(n=10)} SELECT doc, list(id ORDER BY pos, place) AS ids FROM coded GROUP BY doc")
def encode_docs(spark, sf_dir):
    model, docs = trained(spark, sf_dir)
    return model.encode(docs, model.vocabulary())


@query(f"""WITH {trained_ctes('benchmark', 'item_id', 10)}, {vocab_ctes(10)},
other AS (SELECT conv_id * 1000 + turn AS doc, unnest({WORDS}) AS word FROM conversations),
sym AS (SELECT unnest(list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '<|w|>')) AS t FROM other)
SELECT count(*) AS n, count(*) FILTER (WHERE v.id IS NULL) AS unknown FROM sym LEFT JOIN vocab v ON v.token = sym.t""")
def encode_unk_rate(spark, sf_dir):
    model, _ = trained(spark, sf_dir, "benchmark", key="item_id")
    talk = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    ids = bpe.Bpe(merges=[]).encode(talk, model.vocabulary()).select(F.explode("ids").alias("id"))
    return ids.agg(F.count("*").alias("n"), F.count_if(F.col("id") == 0).alias("unknown"))


@query(f"WITH {trained_ctes('benchmark', 'item_id', 10)} SELECT doc, list(t ORDER BY pos, place) AS tokens FROM (SELECT doc, pos, unnest(k) AS t, generate_subscripts(k, 1) AS place FROM (SELECT e.doc, e.pos, {tokens_of('w.s')} AS k FROM each e JOIN w10 w USING (word))) GROUP BY doc")
def decode_ids(spark, sf_dir):
    model, docs = trained(spark, sf_dir, "benchmark", key="item_id")
    vocabulary = model.vocabulary()
    return bpe.decode(model.encode(docs, vocabulary, "item_id"), vocabulary)


@query(f"SELECT item_id AS doc, trim(array_to_string({PLAIN}, ' ')) AS text FROM benchmark")
def detokenize_word(spark, sf_dir):
    plain = bpe.Bpe(merges=[]).tokenize(table(spark, sf_dir, "benchmark"), "item_id")
    rows = plain.groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tokens"))), lambda x: x.getField("tokens"))).alias("tokens"))
    return rows.select("doc", bpe.detokenize(F.col("tokens")).alias("text"))


@query(f"SELECT item_id AS doc, array_to_string({PLAIN}, ' ') AS text FROM benchmark")
def detokenize_byte(spark, sf_dir):
    plain = bpe.Bpe("byte", merges=[]).tokenize(table(spark, sf_dir, "benchmark"), "item_id")
    rows = plain.groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "tokens"))), lambda x: x.getField("tokens"))).alias("tokens"))
    return rows.select("doc", bpe.detokenize(F.col("tokens"), "byte").alias("text"))


OLD_IDS = [("b", 7), ("<|unk|>", 3), ("a", 5), ("d", 5), ("c", 9)]


@query("SELECT token, (row_number() OVER (ORDER BY token <> '<|unk|>', id, token) - 1)::INT AS id FROM (VALUES ('b', 7), ('<|unk|>', 3), ('a', 5), ('d', 5), ('c', 9)) t(token, id)")
def renumber_ids(spark, sf_dir):
    return bpe.renumber(spark.createDataFrame(OLD_IDS, "token string, id int"))


# -- unigram ---------------------------------------------------------------------------------------
LINES = """lines AS MATERIALIZED (SELECT item_id AS doc, line, '▁' || replace(f, ' ', '▁') AS sentence FROM (
  SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS f FROM benchmark) WHERE f <> '')"""
GRAMS = """starts AS (SELECT doc, line, sentence, unnest(range(1, length(sentence) + 1)) AS place FROM lines),
sizes AS (SELECT doc, line, sentence, place, unnest(range(1, least(6, length(sentence) - place + 1) + 1)) AS size FROM starts),
grams AS MATERIALIZED (SELECT substr(sentence, place, size) AS piece, count(*) AS freq, min(struct_pack(doc := doc, line := line, place := place, size := size)) AS f FROM sizes GROUP BY 1)"""
PIECES = """pieces AS (SELECT piece, freq, (row_number() OVER (ORDER BY length(piece) > 1, CASE WHEN length(piece) = 1 THEN 0 ELSE -freq END, f.doc, f.line, f.place, f.size))::INT AS ord FROM grams)"""


@query(f"WITH {LINES} SELECT doc, line::INT AS line, sentence FROM lines")
def normalize_sentences(spark, sf_dir):
    return unigram.sentences(table(spark, sf_dir, "benchmark"), "item_id")


@query(f"WITH {LINES}, {GRAMS} SELECT piece, freq, f.doc AS doc, f.line::INT AS line, f.place::INT AS place, f.size::INT AS size FROM grams")
def unigram_ngrams(spark, sf_dir):
    return unigram.ngrams(unigram.sentences(table(spark, sf_dir, "benchmark"), "item_id"))


@query(f"WITH {LINES}, {GRAMS}, {PIECES} SELECT piece, ord FROM pieces WHERE ord <= 1000")
def unigram_init_pieces(spark, sf_dir):
    return unigram.initial_pieces(unigram.ngrams(unigram.sentences(table(spark, sf_dir, "benchmark"), "item_id")), 1000)


@query(f"""WITH {LINES}, {GRAMS}, {PIECES},
kept AS (SELECT piece, CASE WHEN ord <= 1000 THEN freq ELSE 0 END AS freq, row_number() OVER (ORDER BY length(piece) > 1, CASE WHEN length(piece) = 1 THEN ord END, freq DESC, length(piece), ord) AS rank FROM pieces WHERE ord <= 1000)
SELECT piece, rank::INT AS ord, freq, round(-ln(freq / sum(freq) OVER ()), 6) AS cost FROM kept WHERE rank <= 500""")
def unigram_rescore(spark, sf_dir):
    grams = unigram.ngrams(unigram.sentences(table(spark, sf_dir, "benchmark"), "item_id"))
    kept = unigram.prune(unigram.initial_pieces(grams, 1000), grams.select("piece", "freq"), 500)
    return unigram.rescore(kept).select("piece", "ord", "freq", F.round("cost", 6).alias("cost"))


@query()
def unigram_segment(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return unigram.Unigram(vocab_size=500, em_steps=2).train(items, "item_id").tokenize(items, "item_id")


@query()
def unigram_segment_documents(spark, sf_dir):
    """Every line of every document in the pieces that the benchmark taught."""
    model = unigram.Unigram(vocab_size=500, em_steps=2).train(table(spark, sf_dir, "benchmark"), "item_id")
    return model.tokenize(table(spark, sf_dir, "documents"))


# -- token streams ---------------------------------------------------------------------------------
CHARS = "stream AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY item_id, place) - 1) AS pos, id FROM (SELECT item_id, generate_subscripts(string_split(text, ''), 1) AS place, ascii(unnest(string_split(text, ''))) AS id FROM benchmark))"


def _stream(spark, sf_dir):
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.ascii(c))
    return dataset.token_stream(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), ids.alias("ids")))


@query(f"WITH {CHARS} SELECT pos::BIGINT AS pos, id FROM stream")
def token_stream(spark, sf_dir):
    return _stream(spark, sf_dir)


WINDOW = "SELECT s.pos::BIGINT AS start, list(t.id ORDER BY t.pos) FILTER (WHERE t.pos < s.pos + 16) AS x, list(t.id ORDER BY t.pos) FILTER (WHERE t.pos > s.pos) AS y FROM {s} s JOIN stream t ON t.pos BETWEEN s.pos AND s.pos + 16 GROUP BY s.pos HAVING count(*) = 17"


@query(f"WITH {CHARS}, starts AS (SELECT pos FROM stream WHERE pos % 16 = 0) {WINDOW.format(s='starts')}")
def windows_strided(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    return dataset.windows(stream, dataset.strided_starts(stream, 16, 16), 16)


@query(f"WITH {CHARS}, starts AS (SELECT pos FROM (VALUES (0), (5), (17), (100), (1000)) v(pos)) {WINDOW.format(s='starts')}")
def batch_given_starts(spark, sf_dir):
    starts = spark.createDataFrame([(0,), (5,), (17,), (100,), (1000,)], "start bigint")
    return dataset.windows(_stream(spark, sf_dir), starts, 16)


# -- tensors ---------------------------------------------------------------------------------------
VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
ROUND = "list_transform({x}, lambda v: round(v, 5))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _round(c):
    return F.transform(c, lambda v: tensor.rounded(v, 5))


@query("SELECT q.q::INT AS q, k.k::INT AS k, k.k <= q.q AS visible FROM range(8) q(q), range(8) k(k)")
def causal_mask(spark, sf_dir):
    return spark.range(8).select(F.col("id").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).withColumn("visible", F.col("k") <= F.col("q"))


@query(f"""SELECT vec_id, list_transform(range(1, 5), lambda i: round(list_sum(list_transform(range(1, 65), lambda j: v[j] * (((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE))), 5)) AS y FROM (SELECT vec_id, {VEC} AS v FROM embeddings)""")
def linear_proj(spark, sf_dir):
    weights = F.array(*[F.array(*[F.lit(((i * 7 + j * 3) % 11 - 5) / 10.0) for j in range(1, 65)]) for i in range(1, 5)])
    return _vectors(spark, sf_dir).select("vec_id", _round(tensor.linear(F.col("v"), weights)).alias("y"))


@query(f"SELECT vec_id, list_transform(v, lambda x: round((x - m) / sqrt(q - m * m + 1e-5), 5)) AS y FROM (SELECT vec_id, v, list_sum(v) / 64 AS m, list_sum(list_transform(v, lambda x: x * x)) / 64 AS q FROM (SELECT vec_id, {VEC} AS v FROM embeddings))")
def layer_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _round(tensor.layer_norm(F.col("v"))).alias("y"))


@query(f"SELECT vec_id, list_transform(e, lambda x: round(x / list_sum(e), 5)) AS y FROM (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (SELECT vec_id, {VEC} AS v FROM embeddings))")
def softmax_rows(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _round(tensor.softmax(F.col("v"))).alias("y"))


ERF = "1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-z * z)"


def gelu_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    return f"{x} * 0.5 * (1 + sign({x}) * (1 - ({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))) * exp(-{x} * {x} / 2)))"


@query(f"SELECT vec_id, list_transform(v, lambda x: round({gelu_sql('x')}, 5) + 0.0) AS y FROM (SELECT vec_id, {VEC} AS v FROM embeddings)")
def gelu(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: tensor.rounded(tensor.gelu(x), 5) + F.lit(0.0)).alias("y"))


@query("SELECT vec_id, h::INT AS head, list_transform(embedding[(h * 16 + 1):(h * 16 + 16)], lambda x: x::DOUBLE) AS v FROM embeddings, range(4) t(h)")
def split_heads(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(tensor.split_heads(F.col("v"), 4, 16)).alias("head", "v"))


@query("""WITH r AS (SELECT vec_id // 32 AS seq, vec_id % 32 AS pos, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.seq, q.pos, k.pos AS kpos, k.v AS kv, list_sum(list_transform(range(1, 65), lambda j: q.v[j] * k.v[j])) / 8.0 AS s FROM r q JOIN r k ON q.seq = k.seq AND k.pos <= q.pos),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos)) AS e FROM s),
w AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, pos) AS w FROM m)
SELECT seq, pos, list(y ORDER BY j) AS y FROM (SELECT seq, pos, j, round(sum(w * kv[j]), 4) + 0.0 AS y FROM w, range(1, 65) t(j) GROUP BY seq, pos, j) GROUP BY seq, pos""")
def attention_causal(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("seq"), (F.col("vec_id") % 32).alias("pos"), "v")
    return tensor.causal_attention(rows, 64).select("seq", "pos", F.transform("out", lambda v: tensor.rounded(v, 4) + F.lit(0.0)).alias("y"))


@query("SELECT label AS seq, vec_id AS token, logit FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 1) AS logit, rank() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 1) DESC) AS r FROM embeddings) WHERE r <= 5")
def top_k_filter(spark, sf_dir):
    logits = _vectors(spark, sf_dir).select(F.col("label").alias("seq"), F.col("vec_id").alias("token"), tensor.rounded(F.get("v", F.lit(0)), 1).alias("logit"))
    return tensor.top_k(logits, 5)


@query(f"SELECT vec_id, round(ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[label % 64 + 1], 5) AS loss FROM (SELECT vec_id, label, {VEC} AS v FROM embeddings)")
def cross_entropy(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", tensor.rounded(tensor.cross_entropy(F.col("v"), F.col("label") % 64), 5).alias("loss"))


@query(f"SELECT vec_id, list_transform(v, lambda x: round(x * CASE WHEN n > 1 THEN 1.0 / (n + 1e-6) ELSE 1.0 END, 5)) AS g FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, {VEC} AS v FROM embeddings))")
def grad_clip(spark, sf_dir):
    norm = F.sqrt(tensor.dot(F.col("v"), F.col("v")))
    return _vectors(spark, sf_dir).select("vec_id", tensor.given(tensor.clip_scale(norm, 1.0), lambda k: F.transform("v", lambda x: tensor.rounded(x * k, 5))).alias("g"))


@query(f"""SELECT vec_id, list_transform(range(1, 65), lambda i: round(v[i] * (1 - 3e-4 * 0.1) - 3e-4 * ((0.1 * v[i % 64 + 1]) / (1 - 0.9)) / (sqrt((0.05 * v[i % 64 + 1] * v[i % 64 + 1]) / (1 - 0.95)) + 1e-8), 6)) AS p
FROM (SELECT vec_id, {VEC} AS v FROM embeddings)""")
def adamw_step(spark, sf_dir):
    zero = F.lit(0.0)
    gradient = F.concat(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, 1))
    return _vectors(spark, sf_dir).select("vec_id", F.zip_with("v", gradient, lambda p, g: tensor.rounded(tensor.adamw(p, g, zero, zero, 1).getField("p"), 6)).alias("p"))


@query(f"SELECT vec_id, list_transform(list_zip(v, range(0, 64)), lambda z: round(z[1] + sin((vec_id % 32) * (z[2] + 1) / 64.0::DOUBLE), 5)) AS y FROM (SELECT vec_id, {VEC} AS v FROM embeddings)")
def positional_add(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("pos", F.col("vec_id") % 32)
    places = spark.range(32).select(F.col("id").alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("id") * j / F.lit(64.0))).alias("p"))
    return tensor.add_positions(rows, places).select("vec_id", _round("v").alias("y"))


@query(f"SELECT item_id AS doc, place, list_transform(e.embedding, lambda x: round(x::DOUBLE, 5)) AS y FROM (SELECT item_id, generate_subscripts({PLAIN}, 1) - 1 AS place, length(unnest({PLAIN})) AS id FROM benchmark) JOIN embeddings e ON e.vec_id = id")
def embedding_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), F.transform(T.split_words(F.col("text")), lambda w: F.length(w).cast("long")).alias("ids"))
    found = tensor.embed(ids, _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "v"))
    return found.select("doc", F.col("place").cast("long").alias("place"), _round("v").alias("y"))


@query(f"""WITH up AS (SELECT vec_id, i, list_sum(list_transform(range(1, 65), lambda j: v[j] * (((i * 7 + j * 3) % 11 - 5) / 10.0::DOUBLE))) AS x FROM (SELECT vec_id, {VEC} AS v FROM embeddings), range(1, 9) t(i)),
act AS (SELECT vec_id, i, x * 0.5 * (1 + sign(x) * ({ERF})) AS a FROM (SELECT vec_id, i, x, z, 1 / (1 + 0.3275911 * z) AS t FROM (SELECT vec_id, i, x, abs(x) / sqrt(2.0) AS z FROM up))),
hidden AS (SELECT vec_id, list(a ORDER BY i) AS h FROM act GROUP BY vec_id)
SELECT vec_id, list_transform(range(1, 5), lambda o: round(list_sum(list_transform(range(1, 9), lambda i: h[i] * (((o * 5 + i * 3) % 7 - 3) / 10.0::DOUBLE))), 4) + 0.0) AS y FROM hidden""")
def feed_forward(spark, sf_dir):
    up = F.array(*[F.array(*[F.lit(((i * 7 + j * 3) % 11 - 5) / 10.0) for j in range(1, 65)]) for i in range(1, 9)])
    down = F.array(*[F.array(*[F.lit(((o * 5 + i * 3) % 7 - 3) / 10.0) for i in range(1, 9)]) for o in range(1, 5)])
    return _vectors(spark, sf_dir).select("vec_id", F.transform(tensor.feed_forward(F.col("v"), up, down), lambda x: tensor.rounded(x, 4) + F.lit(0.0)).alias("y"))


@query(f"""SELECT vec_id, list_position(list_transform(range(1, 65), lambda i: list_sum(p[1:i]) > u), true)::INT - 1 AS drawn FROM (
  SELECT vec_id, (vec_id * 37 % 101) / 101.0::DOUBLE AS u, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM (SELECT vec_id, {VEC} AS v FROM embeddings)))""")
def multinomial_given_u(spark, sf_dir):
    u = (F.col("vec_id") * 37 % 101) / F.lit(101.0)
    return _vectors(spark, sf_dir).select("vec_id", tensor.draw(tensor.softmax(F.col("v")), u).alias("drawn"))


def _sql_weight(a: int, b: int, m: int, scale: float, i: str, j: str) -> str:
    return f"((({i}) * {a} + ({j}) * {b}) % {m} - {m // 2}) / {scale}::DOUBLE"


#: Test weights: of output i and input j, by a rule (factors, modulus, scale) that Spark and SQL both work out.
MAPS = {"q": (7, 3, 11, 60.0), "k": (5, 2, 13, 60.0), "v": (3, 7, 11, 40.0), "o": (2, 9, 13, 50.0), "up": (4, 5, 11, 30.0), "down": (9, 4, 7, 30.0)}


def _block_weights(wide: int = 64, hidden: int = 32) -> dict[str, list]:
    out = {}
    for name, (a, b, m, scale) in MAPS.items():
        rows, columns = (hidden, wide) if name == "up" else (wide, hidden) if name == "down" else (wide, wide)
        out[f"{name}.w"] = [[((i * a + j * b) % m - m // 2) / scale for j in range(1, columns + 1)] for i in range(1, rows + 1)]
        out[f"{name}.b"] = [(i % 5 - 2) / 10.0 for i in range(1, rows + 1)]
    for name in ("ln1", "ln2"):
        out[f"{name}.g"], out[f"{name}.b"] = [1 + (i % 3) / 10.0 for i in range(1, wide + 1)], [(i % 4 - 1) / 20.0 for i in range(1, wide + 1)]
    return out


def _linear_sql(name: str, x: str, rows: int = 64, columns: int = 64) -> str:
    return f"list_transform(range(1, {rows + 1}), lambda i: list_sum(list_transform(range(1, {columns + 1}), lambda j: {x}[j] * {_sql_weight(*MAPS[name], 'i', 'j')})) + (i % 5 - 2) / 10.0::DOUBLE)"


def _norm_sql(x: str) -> str:
    m, q = f"(list_sum({x}) / 64)", f"(list_sum(list_transform({x}, lambda u: u * u)) / 64)"
    return f"list_transform(range(1, 65), lambda i: ({x}[i] - {m}) / sqrt({q} - {m} * {m} + 1e-5) * (1 + (i % 3) / 10.0::DOUBLE) + (i % 4 - 1) / 20.0::DOUBLE)"


def _attention_ctes(source: str, x: str) -> str:
    """mixed: (seq, pos, y), four heads of 16 over ``x`` of the table ``source`` (seq, pos, x)."""
    return f"""
qkv AS MATERIALIZED (SELECT seq, pos, {_linear_sql('q', x)} AS q, {_linear_sql('k', x)} AS k, {_linear_sql('v', x)} AS v FROM {source}),
heads AS MATERIALIZED (SELECT seq, pos, h, q[(h * 16 + 1):(h * 16 + 16)] AS q, k[(h * 16 + 1):(h * 16 + 16)] AS k, v[(h * 16 + 1):(h * 16 + 16)] AS v FROM qkv, range(4) t(h)),
scores AS (SELECT a.seq, a.pos, a.h, b.pos AS kpos, b.v, list_sum(list_transform(range(1, 17), lambda j: a.q[j] * b.k[j])) / 4.0 AS s FROM heads a JOIN heads b ON a.seq = b.seq AND a.h = b.h AND b.pos <= a.pos),
powers AS (SELECT *, exp(s - max(s) OVER (PARTITION BY seq, pos, h)) AS e FROM scores),
shares AS (SELECT *, e / sum(e) OVER (PARTITION BY seq, pos, h) AS w FROM powers),
sums AS (SELECT seq, pos, h, j, sum(w * v[j]) AS y FROM shares, range(1, 17) t(j) GROUP BY seq, pos, h, j),
flat_heads AS (SELECT seq, pos, list(y ORDER BY h, j) AS x FROM sums GROUP BY seq, pos),
mixed AS MATERIALIZED (SELECT seq, pos, {_linear_sql('o', 'x')} AS y FROM flat_heads)"""


SEQUENCES = f"r AS MATERIALIZED (SELECT vec_id // 32 AS seq, vec_id % 32 AS pos, {VEC} AS x FROM embeddings)"


def _sequences(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 32).alias("seq"), (F.col("vec_id") % 32).alias("pos"), F.col("v").alias("x"))


@query(f"WITH {SEQUENCES}, {_attention_ctes('r', 'x')} SELECT seq, pos, list_transform(y, lambda v: round(v, 4) + 0.0) AS y FROM mixed")
def multi_head_attention(spark, sf_dir):
    done = tensor.multi_head_attention(_sequences(spark, sf_dir), _block_weights(), 4)
    return done.select("seq", "pos", F.transform("out", lambda v: tensor.rounded(v, 4) + F.lit(0.0)).alias("y"))


@query(f"""WITH {SEQUENCES}, n1 AS MATERIALIZED (SELECT seq, pos, {_norm_sql('x')} AS z FROM r), {_attention_ctes('n1', 'z')},
middle AS MATERIALIZED (SELECT r.seq, r.pos, list_transform(range(1, 65), lambda i: r.x[i] + mixed.y[i]) AS x FROM r JOIN mixed ON r.seq = mixed.seq AND r.pos = mixed.pos),
n2 AS MATERIALIZED (SELECT seq, pos, x, {_norm_sql('x')} AS z FROM middle),
up AS MATERIALIZED (SELECT seq, pos, x, {_linear_sql('up', 'z', 32)} AS u FROM n2),
act AS MATERIALIZED (SELECT seq, pos, x, list_transform(u, lambda g: {gelu_sql('g')}) AS u FROM up),
down AS MATERIALIZED (SELECT seq, pos, x, {_linear_sql('down', 'u', 64, 32)} AS d FROM act)
SELECT seq, pos, list_transform(range(1, 65), lambda i: round(x[i] + d[i], 4) + 0.0) AS y FROM down""")
def transformer_block(spark, sf_dir):
    done = tensor.transformer_block(_sequences(spark, sf_dir), _block_weights(), 4)
    return done.select("seq", "pos", F.transform("out", lambda v: tensor.rounded(v, 4) + F.lit(0.0)).alias("y"))


# -- more of tokenizers and data sets ---------------------------------------------------------------
@query(f"SELECT doc_id, {PLAIN} AS words FROM documents")
def split_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.split_words(F.col("text")).alias("words"))


@query(f"WITH {trained_ctes('conversations', 'conv_id * 1000 + turn', 1)} SELECT word, {tokens_of('s')} AS tokens FROM w1")
def apply_one_merge(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    state = bpe.with_tokens(bpe.word_counts(talk))
    top = bpe.best_pair(state).first()
    return state.select("word", T.unwrap(bpe.merged(F.col("s"), top.l, top.r)).alias("tokens"))


@query(f"WITH {trained_ctes('benchmark', 'item_id', 20)} SELECT * FROM ({merge_rows(20)})")
def train_word_bpe_20(spark, sf_dir):
    return trained(spark, sf_dir, "benchmark", 20, key="item_id")[0].merge_table(spark)


@query(f"WITH {trained_ctes('benchmark', 'item_id', 20)}, {vocab_ctes(20)} SELECT count(*) AS vocab_size FROM vocab")
def vocab_size(spark, sf_dir):
    return trained(spark, sf_dir, "benchmark", 20, key="item_id")[0].vocabulary().agg(F.count("*").alias("vocab_size"))


@query(f"WITH {trained_ctes('benchmark', 'item_id', 10, 'byte')} SELECT e.doc, e.pos::INT AS pos, e.word, {tokens_of('w.s')} AS tokens FROM each e JOIN w10 w USING (word)")
def tokenize_byte_bpe(spark, sf_dir):
    model, docs = trained(spark, sf_dir, "benchmark", mode="byte", key="item_id")
    return model.tokenize(docs, "item_id")


@query(f"WITH {trained_ctes('documents', 'doc_id', 5, 'byte')}, {vocab_ctes(5, 'byte')}, {ENCODED.format(n=5)} SELECT doc, list(id ORDER BY pos, place) AS ids FROM coded GROUP BY doc")
def encode_byte_docs(spark, sf_dir):
    model, docs = trained(spark, sf_dir, n=5, mode="byte")
    return model.encode(docs, model.vocabulary())


@query(f"WITH {trained_ctes('benchmark', 'item_id', 10)}, {vocab_ctes(10)}, {ENCODED.format(n=10)} SELECT (row_number() OVER (ORDER BY doc, pos, place) - 1)::BIGINT AS pos, id FROM coded")
def encoded_stream(spark, sf_dir):
    model, docs = trained(spark, sf_dir, "benchmark", key="item_id")
    return dataset.token_stream(model.encode(docs, model.vocabulary(), "item_id"))


@query("SELECT (row_number() OVER (ORDER BY doc_id, place) - 1)::BIGINT AS pos, id FROM (SELECT doc_id, generate_subscripts(w, 1) AS place, length(unnest(w)) AS id FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents))")
def document_stream(spark, sf_dir):
    ids = F.transform(T.split_words(F.col("text")), lambda w: F.length(w).cast("long"))
    return dataset.token_stream(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), ids.alias("ids")))


@query("""WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents),
stream AS (SELECT row_number() OVER (ORDER BY doc_id, place) - 1 AS pos, id FROM (SELECT doc_id, generate_subscripts(w, 1) AS place, length(unnest(w)) AS id FROM words)),
shifted AS (SELECT pos, id, lead(id) OVER (ORDER BY pos) AS y FROM stream)
SELECT (pos // 256 * 256)::BIGINT AS start, list(id ORDER BY pos) AS x, list(y ORDER BY pos) AS y FROM shifted GROUP BY pos // 256 HAVING count(y) = 256""")
def document_windows(spark, sf_dir):
    stream = document_stream(spark, sf_dir).withColumn("id", F.col("id").cast("int"))
    return dataset.windows(stream, dataset.strided_starts(stream, 256, 256), 256).select("start", F.col("x").cast("array<bigint>").alias("x"), F.col("y").cast("array<bigint>").alias("y"))


@query(f"WITH {trained_ctes('documents', 'doc_id', 10)} SELECT e.doc, e.pos::INT AS pos, e.word, {tokens_of('w.s')} AS tokens FROM each e JOIN w10 w USING (word)")
def tokenize_documents(spark, sf_dir):
    model, docs = trained(spark, sf_dir)
    return model.tokenize(docs)


@query(f"SELECT token, id FROM (WITH {trained_ctes('benchmark', 'item_id', 10)}, {vocab_ctes(10)} SELECT token, id FROM vocab)")
def vocab_json_round_trip(spark, sf_dir):
    model, _ = trained(spark, sf_dir, "benchmark", key="item_id")
    path = f"{shared_dir(spark)}/lexloom/vocab-{uuid.uuid4().hex}.json"
    vocab_store.save_json(model.vocabulary(), path)
    return vocab_store.load_json(spark, path)


@query("SELECT (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS doc_id, text || chr(10) AS text FROM benchmark")
def read_folder(spark, sf_dir):
    """The benchmark's items written as text files, one each, and read back in the order of their paths."""
    path = f"{shared_dir(spark)}/lexloom/texts-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").coalesce(1).sortWithinPartitions("item_id").select("text").write.option("maxRecordsPerFile", 1).text(path)
    return corpus.read_texts(spark, path).select("doc_id", "text")


@query()
def train_word_bpe_2000(spark, sf_dir):
    return trained(spark, sf_dir, n=2000)[0].merge_table(spark)


@query(f"WITH {LINES}, {GRAMS}, {PIECES} SELECT piece, round(ln(count(*) OVER ()), 6) AS cost FROM pieces WHERE ord <= 1000")
def unigram_uniform_scores(spark, sf_dir):
    pieces = unigram.initial_pieces(unigram.ngrams(unigram.sentences(table(spark, sf_dir, "benchmark"), "item_id")), 1000)
    return pieces.select("piece", F.round(F.log(F.count("*").over(Window.partitionBy())), 6).alias("cost"))


@query(f"WITH {CHARS} SELECT pos::BIGINT AS pos, id AS x, lead(id) OVER (ORDER BY pos) AS y FROM stream QUALIFY y IS NOT NULL")
def shifted_targets(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    at = dataset.windows(stream, dataset.strided_starts(stream, 1, 1), 1)
    return at.select(F.col("start").alias("pos"), F.get("x", F.lit(0)).alias("x"), F.get("y", F.lit(0)).alias("y"))


@query(f"WITH {CHARS} SELECT list(id ORDER BY pos) FILTER (WHERE pos >= 100 AND pos < 164) AS ids, count(*) AS length FROM stream")
def token_range(spark, sf_dir):
    stream = _stream(spark, sf_dir)
    return dataset.token_range(stream, 100, 164).crossJoin(stream.agg(F.count("*").alias("length")))


@query(f"SELECT conv_id, turn, array_to_string({PLAIN}, '') AS text FROM conversations")
def pretrained_detokenize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pretrained.detokenize(T.split_words(F.col("text"))).alias("text"))


#: The tokenizer file of the pre-trained queries.
PRETRAINED = "byte_bpe_50k.json"


@query()
def pretrained_tokenize(spark, sf_dir):
    model = pretrained.Pretrained(spark, public_tokenizers.path(PRETRAINED))
    return table(spark, sf_dir, "documents").select("doc_id", model.tokenize(F.col("text")).alias("tokens"))


@query("SELECT doc_id, text FROM documents")
def pretrained_round_trip(spark, sf_dir):
    model = pretrained.Pretrained(spark, public_tokenizers.path(PRETRAINED))
    return table(spark, sf_dir, "documents").select("doc_id", model.decode(model.encode(F.col("text"))).alias("text"))


# -- language model ----------------------------------------------------------------------------------
def _model(spark, sf_dir, iters):
    """A small model of the benchmark's characters."""
    stream = _stream(spark, sf_dir).withColumn("id", F.least("id", F.lit(255)))
    model = gpt.Gpt(gpt.Config(256, 16, 2, 2, 32))
    return gpt.Trainer(model, gpt.Training(16, 3e-3, 0.01, iters)).train(stream, stream.count()), stream


@query()
def train_loss_curve(spark, sf_dir):
    losses = _model(spark, sf_dir, 200)[0].history
    return spark.createDataFrame(list(enumerate(losses)), "iter int, loss double")


@query()
def gpt_window_losses(spark, sf_dir):
    trainer, stream = _model(spark, sf_dir, 100)
    return trainer.model.window_losses(dataset.windows(stream, dataset.strided_starts(stream, 16, 16), 16))


@query()
def gpt_generate(spark, sf_dir):
    trainer, _ = _model(spark, sf_dir, 100)
    ids = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(255)))
    return trainer.model.generate(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc"), ids.alias("ids")), 32, top_k=5)
