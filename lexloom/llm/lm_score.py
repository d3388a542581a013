"""Language-model scores of documents: a counted word model, and causal self-attention on subwords.

Both models learn from all training texts. Words, subwords and pairs of subwords are counted on
the executors. The attention model is trained in rounds: in each, every partition learns from
another share of its rows of ids, all of them in the end, from the same parameters, and the
partitions' results are averaged by their numbers of ids. Each chunk of documents gets
back the counts of its own words; no dictionary of the corpus is broadcast. Texts are cut into
subwords once and never shuffled; all else reads the ids, whose spelling tells words apart.

A token's probability is a mixture: SHARE times what attention gives its subwords, the rest from
the counted model. Attention's chance of a word is that of its first subword among those that
open a word, times those of the others, times the chance that the next subword opens a word or
ends the text; so all words' chances add up to one at most. The counted model gives words that
training has not seen one share together, which attention's chances divide among them.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import attention
from lexloom.llm.bytesets import LOWER, Prefix, blocks, expand, flat, mix, words
from lexloom.llm.byte_bpe import Slices, merge, read_ranks
from lexloom.llm.staging import parts_for, stage
from lexloom.llm.sums import total_blocks
from lexloom.llm.threads import one_thread
from lexloom.llm.windows import blob_rows, joined, split_by

#: Bytes of text in a chunk: neighbouring documents that are read, asked for and scored together.
CHUNK = 6 << 20
#: Rounds of training, and updates of all partitions in a round at least. Together the rounds learn from every row once, on small corpora oftener.
ROUNDS, LEAST_UPDATES = 4, 200
#: Ids that are worked on at once, so that they stay in the cache.
RUN = 1 << 17
#: Share of the attention model in a token's probability; the counted word model has the rest.
SHARE = 0.8

KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("v", pa.int64())])
_caches: dict[str, "Subwords"] = {}


class Counts:
    """Counts by key, found by a table of the keys' leading bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.start = np.searchsorted(self.keys >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64))

    def __call__(self, some: np.ndarray) -> np.ndarray:
        """The count of each key, 0 of one that isn't there."""
        out, place = np.zeros(len(some), np.int64), (some >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, stop = self.start[place], self.start[place + 1]
        live = np.flatnonzero(at < stop)
        while len(live):
            hit = self.keys[at[live]] == some[live]
            out[live[hit]] = self.counts[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


def opening_ids(ranks: dict[bytes, int]) -> np.ndarray:
    """Which ids open a word (they begin with a space, as no other part of one does) or end a text."""
    opens = np.zeros(len(ranks) + 1, bool)
    opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
    opens[len(ranks)] = True
    return opens


class Subwords(Slices):
    """Word -> ids of " word", as little-endian 32-bit integers; the tiktoken library merges where it is installed."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        try:
            import tiktoken

            self.merged = tiktoken.Encoding("subwords", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        except (ImportError, AttributeError):
            self.merged = lambda piece: merge(piece, ranks)

    def __missing__(self, word: bytes) -> bytes:
        ids = array("I", self.merged(b" " + word))
        if sys.byteorder == "big":
            ids.byteswap()
        if len(self) >= self.limit:
            self.clear()
        out = ids.tobytes()
        if len(word) <= 64:
            self[word] = out
        return out


def subwords_of(path: str, ranks: dict[bytes, int]) -> Subwords:
    if path not in _caches:
        _caches[path] = Subwords(ranks)
    return _caches[path]


def forget_words() -> None:
    """Empty this worker's cache: once all texts are encoded no step needs it."""
    _caches.clear()


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one word of each kind, kind of each word): words of up to 15 bytes are told apart by all their bytes and their length, a longer one is a kind of its own."""
    size, padded = ends - starts, np.append(data, np.zeros(15, np.uint8))
    low, high = np.zeros((2, len(starts)), np.uint64)
    for k in range(15):
        part = low if k < 8 else high
        part |= np.where(size > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * (k % 8))
    high |= size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > 15)
    low[long], high[long] = long, 16 << 56
    order = np.argsort(mix(low + mix(high)))
    a, b = low[order], high[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # two kinds of one hash come apart, in more pieces than need be at worst
    kinds = np.empty(len(order), np.int64)
    kinds[order] = np.cumsum(head) - 1
    return order[head], kinds


def token_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, cache: Subwords, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each text and the end): subwords of each text's words, then one end."""
    raw = data.tobytes()
    some, kinds = distinct(data, starts, ends)
    coded = list(map(cache.__getitem__, [raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]))
    size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    lead, sizes = np.cumsum(size) - size, size[kinds]
    edge = np.concatenate([[0], np.cumsum(sizes)])[first]
    ids = np.frombuffer(b"".join(coded), "<u4").take(expand(lead[kinds], sizes))
    return np.insert(ids, edge[1:], end_id), edge + np.arange(len(edge))


def lowered(data: np.ndarray, offsets: np.ndarray):
    """(first row, end row, bytes, word starts, word ends, first word of each text and the end) by block."""
    for row, end in blocks(offsets):
        part = LOWER[data[offsets[row] : offsets[end]]]
        yield row, end, part, *words(part, offsets[row : end + 1] - offsets[row])


class Chunks:
    """Rows of a table of chunks: (held, ids, sizes) at the given columns."""

    def __init__(self, wide: str, held: int, ids: int, sizes: int):
        self.wide, self.at = wide, (held, ids, sizes)

    def rows(self, batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(held, ids, first id of each text and the end) of each chunk."""
        for held, ids, sizes in zip(*(batch.column(c) for c in self.at)):
            edge = np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_buffer(), "<u4").astype(np.int64))])
            yield held.values.to_numpy(zero_copy_only=False), np.frombuffer(ids.as_buffer(), self.wide), edge

    def learned(self, batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, first id of each text and the end) of each chunk's texts that aren't held out."""
        for batch in batches:
            for held, ids, first in self.rows(batch):
                pa.default_memory_pool().release_unused()
                if held.any():
                    sizes = np.diff(first)
                    ids, first = ids[np.repeat(~held, sizes)], np.concatenate([[0], np.cumsum(sizes[~held])])
                if len(ids):
                    yield ids, first


def tokens_of(ids: np.ndarray, opens: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first id of each token, which tokens are ends, key of each word): only a token's first id opens one."""
    heads = np.flatnonzero(opens[ids])
    closes = ids[heads] == end_id
    after, size = np.append(heads[1:], len(ids)), ids.itemsize
    return heads, closes, Prefix(ids.view(np.uint8), 0).ranges(heads[~closes] * size, after[~closes] * size)


def summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], (np.add.reduceat(counts, heads) if len(heads) else counts)


def train(texts: DataFrame, ranks: dict[bytes, int], wide: str) -> tuple[tuple, int, int]:
    """((vocabulary, parameters), tokens, texts) learned from all texts that aren't held out; texts: (held, ids, sizes) by chunk.

    What reaches the driver are sums whose size depends on the model alone. Without texts the
    parameters stay as they begin.
    """
    spark, end_id, opens = texts.sparkSession, len(ranks), opening_ids(ranks)
    chunks = Chunks(wide, 0, 1, 2)
    pairs_shape = (attention.INPUTS + 2, attention.OWN + 2)

    def count(batches):
        out = np.zeros((end_id + 1, 1))
        for ids, _ in chunks.learned(batches):
            out[:, 0] += np.bincount(ids, minlength=end_id + 1)
        return out

    counts = total_blocks(texts, count, end_id + 1, 1)[:, 0]
    vocabulary = attention.Vocabulary(counts, opens)
    given = spark.sparkContext.broadcast(vocabulary)

    def pairs(batches):
        out = np.zeros(pairs_shape)
        for ids, first in chunks.learned(batches):
            out += attention.pair_counts(ids, first, given.value)
        return out

    pair = attention.pair_logits(total_blocks(texts, pairs, *pairs_shape))
    p = attention.new_parameters(pair)
    if not counts.any():
        return (vocabulary, p), 0, 0
    fixed, total, least = spark.sparkContext.broadcast(pair), int(counts.sum()), LEAST_UPDATES * attention.ROWS * attention.STEP
    parts, times = min(ROUNDS, max(1, total // least)), max(1, -(-least // total))
    rows = min(attention.MOST_ROWS, max(attention.ROWS, total // (attention.STEP * ROUNDS * LEAST_UPDATES)))
    vector = attention.packed(p)
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(vector)

        def learn(batches):
            forget_words()
            one_thread()
            trainer, n, read = None, 0, 0
            for ids, first in chunks.learned(batches):
                if trainer is None:
                    rate = attention.RATE * (1 - k / ROUNDS)  # noqa: B023
                    trainer = attention.Trainer(attention.unpacked(now.value, fixed.value), given.value, rate, seed=k)  # noqa: B023
                for _ in range(times):
                    trainer.read = read
                    trainer.learn_all(ids, first, rows, k % parts, parts)  # noqa: B023
                read, n = trainer.read, n + len(ids)
            return np.append(attention.packed(trainer.p), 1.0)[:, None] * n if trainer else np.zeros((len(vector) + 1, 1))  # noqa: B023

        summed_ = total_blocks(texts, learn, len(vector) + 1, 1)[:, 0]
        vector = summed_[:-1] / summed_[-1]
    return (vocabulary, attention.unpacked(vector, pair)), int(counts[opens].sum()), int(counts[end_id])


def word_logs(log: np.ndarray, opening: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log of attention's chance of each token (word or end), from its ids' logs; heads: first ids, ends: which are ends.

    A word's first id is taken among those that open one, and the word has to be over after its
    last: the next id, whose place tells that chance, opens a word or ends the text.
    """
    at = opening[heads]
    after = np.append(at[1:], 0.0)
    return np.add.reduceat(log, heads) - at + np.where(ends, 0.0, after)


def score(docs: DataFrame, held_out, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score every whole text; ``held_out`` is a column that says which rows nothing is learned from.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that occur in training),
    train_tokens, base_score (add-one word model, log10) and score (the mixture, log10). Words are
    the same if their 61-bit hashes are. Null and
    empty texts are one end; a null held_out counts as false; without training texts every token is
    unknown; repeated rows score alike; other columns aren't read. ``score`` depends a little on how
    the input is dealt into partitions, as each learns on its own between averages; all else does not.
    """
    spark = docs.sparkSession
    parts = parts_for(docs, CHUNK)
    ranks = read_ranks(path)
    sent = spark.sparkContext.broadcast(ranks)
    end_id, kind, opens = len(ranks), docs.schema[key].dataType.simpleString(), opening_ids(ranks)
    wide = "<u2" if end_id < 1 << 16 else "<u4"
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.coalesce(held_out, F.lit(False)).alias("held"))
    fields = lambda schema: ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint' if f.type == pa.int64() else 'binary'}" for f in schema)

    def encode(batches):
        cache, kept, size, n = subwords_of(path, sent.value), [], 0, TaskContext.get().partitionId() << 32

        def row():
            ids, held, coded, sizes = zip(*kept)
            listed = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, c))], pa.int32()), pa.concat_arrays(c)) for c in (ids, held)]
            blobs = [pa.array([np.concatenate(c).tobytes()], pa.binary()) for c in (coded, sizes)]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *listed, *blobs], ["chunk", "doc_id", "held", "ids", "sizes"])

        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b, part, starts, ends, first in lowered(data, offsets):
                ids, edge = token_ids(part, starts, ends, first, cache, end_id)
                kept.append((batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), ids.astype(wide), np.diff(edge).astype("<u4")))
                size += len(part)
                if size >= CHUNK:
                    yield row()
                    kept, size, n = [], 0, n + 1
        if kept:
            yield row()

    encoded = stage(given.mapInArrow(encode, f"chunk bigint, doc_id array<{kind}>, held array<boolean>, ids binary, sizes binary"), "subwords")
    model, n_tokens, texts = train(encoded.select("held", "ids", "sizes"), ranks, wide)

    def list_keys(batches):  # each chunk's words, with how often its training texts hold them
        chunks = Chunks(wide, 1, 2, 3)
        for batch in batches:
            for chunk, (held, ids, first) in zip(batch.column(0).to_pylist(), chunks.rows(batch)):
                keys, counts = [], []
                for a, b in blocks(first, RUN):
                    heads, closes, mine = tokens_of(ids[first[a] : first[b]], opens, end_id)
                    of = np.searchsorted(first[a : b + 1] - first[a], heads[~closes], "right") - 1
                    k, c = summed([mine], [(~held[a:b])[of].astype(np.int64)])
                    keys.append(k)
                    counts.append(c)
                keys, counts = summed(keys, counts)
                bucket = ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                yield from blob_rows(KEYS, [(b, chunk, keys[w].tobytes(), counts[w].astype("<u4").tobytes()) for b, w in split_by(bucket)]).to_batches()

    def answer(table):  # the corpus's counts of each chunk's words, where there are any
        keys, n = joined(table.column("keys"), "<u8")
        counts = joined(table.column("counts"), "<u4")[0].astype(np.int64)
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[order], heads) if len(heads) else counts
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(heads, len(keys))))
        chunks = np.repeat(table.column("chunk").to_numpy(), n)
        known = np.flatnonzero(total)
        rows = [(c, keys[known[w]].tobytes(), total[known[w]].astype("<i8").tobytes(), 0) for c, w in split_by(chunks[known])]
        return blob_rows(ANSWERS, [*rows, (None, None, None, int((sums > 0).sum()))])

    asks = encoded.select("chunk", "held", "ids", "sizes").mapInArrow(list_keys, fields(KEYS))
    answers = stage(asks.groupBy("bucket").applyInArrow(answer, fields(ANSWERS)), "words")
    v = (answers.agg(F.sum("v")).first()[0] or 0) + (texts > 0)
    model = spark.sparkContext.broadcast(model)

    def finish(left, right):
        keys, counts = joined(right.column("keys"), "<u8")[0], joined(right.column("counts"), "<i8")[0]
        known = Counts(keys, counts)
        scorer, out = attention.Scorer(*model.value), [[], [], [], []]
        forget_words()
        one_thread()
        pa.default_memory_pool().release_unused()
        for _, ids, first in (x for batch in left.to_batches() for x in Chunks(wide, 2, 3, 4).rows(batch)):
            for a, b in blocks(first, RUN):
                some, own = ids[first[a] : first[b]], first[a : b + 1] - first[a]
                heads, closes, mine = tokens_of(some, opens, end_id)
                seen = np.full(len(heads), texts)  # of every token: words and ends
                seen[~closes] = known(mine)
                counted = np.log(seen + 1.0) - np.log(n_tokens + v + 1.0)
                spelled = word_logs(*scorer.logs(some, own), heads, closes)
                rest = counted + np.where(seen > 0, 0.0, spelled)
                mixed = np.logaddexp(spelled + np.log(SHARE), rest + np.log1p(-SHARE))
                of = np.searchsorted(own, heads, "right") - 1
                for column, weights in zip(out, (None, seen > 0, counted / np.log(10), mixed / np.log(10))):
                    column.append(np.bincount(of, weights, b - a))
        tokens, met, base, logs = (np.concatenate(c) if c else np.zeros(0) for c in out)
        listed = [pc.list_flatten(left.column(c)) for c in ("doc_id", "held")]
        return pa.table({
            "doc_id": listed[0], "held_out": listed[1], "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(met.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(tokens), n_tokens, np.int64)), "base_score": pa.array(base.astype(float)), "score": pa.array(logs.astype(float)),
        })

    known = answers.where("chunk is not null").select("chunk", "keys", "counts")
    return encoded.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
