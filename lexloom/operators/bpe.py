"""Word- and byte-level byte pair encoding as DataFrame transformations.

Training keeps one row for each distinct word, weighted by its count. Ties between
pairs go to the one seen first, by (document, word place, place in the word).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import textops as T
from lexloom.operators import merge_loop, pieces
from lexloom.plans.cut import cut
from lexloom.plans.spread import spread

#: Up to so many distinct words the rounds run in the driver's memory at once (about 1,000 bytes a word); beyond, over pieces of words.
LOCAL_WORDS = 100_000
#: Pieces may have so many symbols for each of these words.
SYMBOLS = 10
#: Vocabularies of up to so many tokens are broadcast after they are counted.
MOST_TOKENS = 1_000_000
#: Up to so many merges are one expression; longer lists run in a vectorised function.
FEW_MERGES = 16


def words(docs: DataFrame, mode: str = "word", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, word) of every word; CJK characters are words of their own in word mode."""
    body = T.isolate_cjk(F.col(text)) if mode == "word" else F.col(text)
    return docs.select(F.col(key).alias("doc"), F.posexplode(T.split_words(body)).alias("pos", "word"))


def first_place(rows: DataFrame, doc: str, *places: str) -> tuple[Column, list[Column]]:
    """(least (doc, places...) as an aggregate ``first``, the columns to read out of it).

    Of integer documents and places (below 2**31) it is packed into one decimal, which Spark keeps
    in a hash table; for the least of a struct it would sort all rows first.
    """
    if rows.schema[doc].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return F.min(F.struct(doc, *places)).alias("first"), [F.col(f"first.{c}") for c in (doc, *places)]
    unit, packed = 1 << 31 * len(places), F.col(doc).cast("decimal(19,0)") * F.lit(1 << 31 * len(places)).cast("decimal(19,0)")
    for k, place in enumerate(reversed(places)):
        packed = packed + F.col(place).cast("decimal(10,0)") * F.lit(1 << 31 * k).cast("decimal(10,0)")
    rest = f"pmod(first, {unit}BD)"
    back = [F.expr(f"(first - {rest}) div {unit}BD").cast(rows.schema[doc].dataType).alias(doc)]
    for k, place in enumerate(places):
        under = 1 << 31 * (len(places) - 1 - k)
        back.append(F.expr(f"pmod({rest} div {under}BD, {1 << 31}L)").cast("int").alias(place))
    return F.min(packed.cast("decimal(38,0)")).alias("first"), back


def word_counts(docs: DataFrame, mode: str = "word", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, cnt, doc, pos): distinct words with their counts and first places."""
    every = words(spread(docs.select(key, text)), mode, key, text)
    first, back = first_place(every, "doc", "pos")
    return every.groupBy("word").agg(F.count("*").alias("cnt"), first).select("word", "cnt", *back)


def with_tokens(counts: DataFrame, mode: str = "word") -> DataFrame:
    """Add the wrapped symbols of each word."""
    return counts.withColumn("s", T.wrap(T.characters(F.col("word")) if mode == "word" else T.byte_tokens(F.col("word"))))


def pair_stats(state: DataFrame) -> DataFrame:
    """(l, r, freq, doc, pos, place): adjacent pairs, overlaps counted, with first places."""
    k = F.split(F.translate("s", T.OPEN, ""), T.CLOSE)  # the last one is empty
    tokens = state.select("cnt", "doc", "pos", k.alias("k"))
    pairs = F.arrays_zip(F.col("k").alias("l"), F.slice("k", F.lit(2), F.size("k")).alias("r"))
    each = tokens.select("cnt", "doc", "pos", F.posexplode(pairs).alias("place", "p")).where("p.r <> ''")
    first, back = first_place(each, "doc", "pos", "place")
    counted = each.groupBy("p.l", "p.r").agg(F.sum("cnt").alias("freq"), first)
    return counted.select(T.unescape(F.col("l")).alias("l"), T.unescape(F.col("r")).alias("r"), "freq", *back)


def best_pair(state: DataFrame) -> DataFrame:
    """The commonest pair, the first seen of ties."""
    return pair_stats(state).orderBy(F.desc("freq"), "doc", "pos", "place").limit(1)


def merged(s: Column, left: str, right: str) -> Column:
    """Every leftmost pair of the wrapped tokens merged."""
    wrap = lambda t: f"{T.OPEN}{T.escaped(t)}{T.CLOSE}"
    return F.replace(s, F.lit(wrap(left) + wrap(right)), F.lit(wrap(left + right)))


def apply_merges(s: Column, merges: list[tuple[str, str]]) -> Column:
    """All merges in learned order."""
    if len(merges) > FEW_MERGES:
        return merge_loop.merged_by(s, merges)
    for left, right in merges:
        s = merged(s, left, right)
    return s


@dataclass
class Bpe:
    """A trainer and tokenizer; mode is 'word' or 'byte' (tokens in hexadecimal)."""

    mode: str = "word"
    num_merges: int | None = None
    min_freq: int = 2
    local_words: int = LOCAL_WORDS
    merges: list[tuple[str, str]] = field(default_factory=list)
    freqs: list[int] = field(default_factory=list)
    state: DataFrame | None = None

    def train(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> "Bpe":
        """Learn merges from the distinct words.

        Up to ``local_words`` of them, counts of pairs are updated on the driver; beyond, it learns
        from pieces of words, as many as fit; where not even those of the commonest pair do, every
        round is one aggregation over the table. All learn the same merges.
        """
        rounds = self.num_merges if self.num_merges is not None else (10 if self.mode == "word" else 100)
        start = cut(with_tokens(word_counts(docs, self.mode, key, text), self.mode))
        small = start.count() <= self.local_words
        found, self.state = self._learn_here(start, rounds) if small else self._learn_from_pieces(start, rounds)
        self.merges, self.freqs = [], []
        for pair, freq in found:
            if pair not in self.merges:  # a pair that wins again keeps its first rank
                self.merges.append(pair)
                self.freqs.append(freq)
        return self

    def _learn_here(self, start: DataFrame, rounds: int):
        table = start.select("doc", "pos", "word", "cnt").toPandas().sort_values(["doc", "pos"])  # local_words rows at most
        found = merge_loop.learn(merge_loop.Symbols.of_words(table["word"].tolist(), table["cnt"].tolist(), self.mode), rounds, self.min_freq)
        return found, start.withColumn("s", apply_merges(F.col("s"), [pair for pair, _ in found]))

    def _learn_from_pieces(self, start: DataFrame, rounds: int):
        least_of_all, most, share = max(1, self.min_freq), self.local_words * SYMBOLS, 8
        if not most:
            return self._learn_there(start, rounds)
        names, found, state = pieces.Names(self.mode), [], cut(pieces.begin(start, self.mode))
        while len(found) < rounds:
            counted = pieces.pairs(state).toArrow()  # as many rows as there are pairs of tokens
            keys, weights = counted["key"].to_numpy(), counted["weight"].to_numpy()
            top = int(weights.max()) if len(keys) else 0
            if top < least_of_all:
                break
            least = max(least_of_all, top // share)
            while True:
                each = pieces.pieces(state, np.sort(keys[weights >= least]))
                first, back = first_place(each, "doc", "pos", "place")
                table = cut(each.groupBy("piece").agg(F.sum("cnt").alias("cnt"), first).select("piece", "cnt", *back))
                size = (table.agg(F.sum(F.length("piece"))).first()[0] or 0) // 4
                if size <= most:
                    break
                if least == top:
                    more, after = self._learn_there(start.withColumn("s", apply_merges(F.col("s"), [p for p, _ in found])), rounds - len(found))
                    return found + more, after
                least = min(top, int((least * top) ** 0.5) + 1)
            share = max(2, top // least) * (4 if size * 8 < most else 2 if size * 2 < most else 1)
            symbols = pieces.symbols(table.toArrow(), names)  # ``most`` of them
            learned = merge_loop.learn(symbols, rounds - len(found), least, pieces.Ends([*symbols.names, *names.number]))
            found += learned
            if len(found) == rounds:
                break
            state = cut(pieces.advance(state, [names.step(*pair) for pair, _ in learned]))
        return found, start.withColumn("s", apply_merges(F.col("s"), [pair for pair, _ in found]))

    def _learn_there(self, state: DataFrame, rounds: int):
        found = []
        for n in range(1, rounds + 1):
            top = best_pair(state).collect()  # one row
            if not top or top[0].freq < self.min_freq:
                break
            pair = (top[0].l, top[0].r)
            found.append((pair, top[0].freq))
            state = state.withColumn("s", merged(F.col("s"), *pair))
            if n % 16 == 0:
                state = cut(state)
        return found, state

    def merge_table(self, spark) -> DataFrame:
        """(rank, l, r, replacement, freq)."""
        rows = [(i + 1, l, r, l + r, f) for i, ((l, r), f) in enumerate(zip(self.merges, self.freqs))]
        return spark.createDataFrame(rows, "rank int, l string, r string, replacement string, freq bigint")

    def vocabulary(self) -> DataFrame:
        """(token, freq, id): the final state's tokens in first-seen order; unknown has id 0.

        Word mode leaves end-of-word out of the counts and puts it last; byte mode counts it.
        """
        each = self.state.select("cnt", "doc", "pos", F.posexplode(T.unwrap(F.col("s"))).alias("place", "token"))
        if self.mode == "word":
            each = each.where(F.col("token") != T.EOW)
        seen = each.groupBy("token").agg(F.sum("cnt").alias("freq"), F.min(F.struct("doc", "pos", "place")).alias("first"))
        if self.mode == "word":
            last = self.state.agg(F.max("doc").alias("doc"), F.lit(1 << 30).alias("pos"), F.lit(0).alias("place"))
            seen = seen.union(last.select(F.lit(T.EOW), F.lit(0).cast("long"), F.struct(F.coalesce("doc", F.lit(0).cast("long")).alias("doc"), "pos", "place")))
        return number_tokens(seen)

    def tokenize(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, pos, word, tokens) without a shuffle: the merges go to every task, which keeps the words it has met."""
        split = self._words(docs, key, text)
        known = split.select("doc", "words", merge_loop.tokenizer(self.merges, self.mode)(F.col("words")).alias("tokens"))
        return known.select("doc", F.posexplode(F.arrays_zip("words", "tokens")).alias("pos", "w")).select("doc", "pos", F.col("w.words").alias("word"), "w.tokens")

    def _words(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(doc, words) of the texts that have any."""
        body, given = self._given(docs, key, text)
        return given.select(F.col(key).alias("doc"), T.split_words(body).alias("words")).where(F.size("words") > 0)

    def _given(self, docs: DataFrame, key: str, text: str) -> tuple[Column, DataFrame]:
        """(the text that is cut into words, the two columns dealt over all cores)."""
        given = docs.select(key, text)
        return T.isolate_cjk(F.col(text)) if self.mode == "word" else F.col(text), given if docs.isStreaming else spread(given)

    def encode(self, docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, ids) without a shuffle: merges and vocabulary (bounded by the merges) go to every task, which keeps the words it has met.

        A text without words has no row, as when its tokens are packed.
        """
        body, given = self._given(docs, key, text)
        known = {r.token: r.id for r in vocabulary.select("token", "id").collect()}
        some = given.where(F.col(text).rlike(T.WORD))  # not by its words, which would be cut below ``spread`` once more
        return some.select(F.col(key).alias("doc"), merge_loop.encoder(self.merges, known, self.mode)(body).alias("ids"))


def number_tokens(seen: DataFrame) -> DataFrame:
    """Ids from (token, freq, first): unknown is 0, others 1.. by first place. The vocabulary alone is ordered."""
    spark = seen.sparkSession
    ids = seen.where(F.col("token") != T.UNK).withColumn("id", F.row_number().over(Window.orderBy("first")))
    return spark.range(1).select(F.lit(T.UNK).alias("token"), F.lit(0).cast("long").alias("freq"), F.lit(0).alias("id")).union(ids.select("token", "freq", "id"))


def encode(tokenized: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, ids): every token's id, 0 if it has none, in order. A vocabulary is bounded by its merges and alphabet and sent to every task."""
    known = vocabulary.select("token", "id")
    flat = tokenized.select("doc", "pos", F.posexplode("tokens").alias("place", "token"))
    found = flat.join(F.broadcast(known) if known.count() <= MOST_TOKENS else known, "token", "left").withColumn("id", F.coalesce("id", F.lit(0)))
    packed = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "place", "id"))).alias("x"))
    return packed.select("doc", F.transform("x", lambda x: x.getField("id")).alias("ids"))


def decode(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, tokens), row by row: an unknown id raises. Texts without ids have no row."""
    names = {r.id: r.token for r in vocabulary.select("id", "token").collect()}  # bounded by merges and alphabet
    return ids.where(F.size("ids") > 0).select("doc", merge_loop.speller(names)(F.col("ids")).alias("tokens"))


def detokenize(tokens: Column, mode: str = "word") -> Column:
    """Text of tokens: only a token that equals end-of-word ends a word."""
    pieces = F.split(T.wrap(tokens), F.lit(f"{T.OPEN}<\\|w\\|>{T.CLOSE}"))
    words_ = F.filter(F.transform(pieces, lambda p: T.unescape(F.translate(p, T.OPEN + T.CLOSE, ""))), lambda w: w != "")
    if mode == "byte":
        spell = lambda w: F.unhex(F.replace(w, F.lit(T.EOW), F.lit("3C7C777C3E"))).cast("string")
        return F.array_join(F.transform(words_, spell), " ")
    return F.trim(T.join_cjk(F.array_join(words_, " ")))


def renumber(ids: DataFrame) -> DataFrame:
    """(token, id) made dense again: unknown first, others by their old ids, ties by token."""
    return ids.select("token", (F.row_number().over(Window.orderBy(F.col("token") != T.UNK, "id", "token")) - 1).alias("id"))
