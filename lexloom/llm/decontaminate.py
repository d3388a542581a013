"""Benchmark decontamination by latent semantic retrieval.

Texts become ids of the words that the benchmark uses; words it doesn't use can't
match, so they only take up places. A randomised SVD of the TF-IDF passages of the whole
corpus, summed over all partitions, gives every word a latent vector. Windows of every text
are compared with every item by cosine; near ones are settled on the words
themselves: a longest common subsequence, and for paraphrases the item's last words.
Long items are searched in overlapping pieces, and short ones, which drown in a window's
vector, by their rarest words; both are settled on the whole item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesets import LOWER, Prefix, blocks, expand, flat, words
from lexloom.llm.rows import without_marks
from lexloom.llm.staging import stage
from lexloom.llm.sums import sorted_sum, total_blocks
from lexloom.llm.threads import one_thread

#: Words of a passage of the SVD, its rank and spare columns, and the seed of its random start.
PASSAGE, RANK, SPARE, SEED = 32, 64, 8, 7
#: Leading components that are left out: they carry what all texts of a language share.
LEADING = 24
#: Least eigenvalue of a component, as a share of the largest one.
REAL = 1e-10
#: Words of a step; windows are 2, 3 or 4 steps, begin at every step, and meet the items of at most 24, 40 or more words.
STEP, SPANS, LENGTHS = 16, (2, 3, 4), (24, 40)
#: Items of more than LONG words are searched in pieces of PIECE words, HOP apart; ones of less than SHORT words by rare words.
LONG, PIECE, HOP, SHORT = 64, 48, 24, 12
#: Least cosine of a candidate, and share of the item's (or piece's) idf weight that its window must hold.
COSINE, SHARED = 0.42, 0.45
#: Longest common subsequence, as a share of the item, of a copy; of a paraphrase, which must also have ANSWER_SHARE of the last ANSWER words.
COPY, PARAPHRASE, ANSWER, ANSWER_SHARE = 0.85, 0.7, 5, 0.6
#: Cells (piece, word) up to which a table says which piece holds which word; beyond, a sorted list does.
CELLS = 1 << 27
#: Bytes of benchmark text that are handled, and broadcast, at once; a larger benchmark takes more rounds.
ITEM_BYTES = 4 << 20

#: ASCII punctuation parts words here, so that a comma or a stop doesn't hide a copy.
CLEAN = LOWER.copy()
CLEAN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end)."""
    data = CLEAN[data]
    starts, ends, first = words(data, offsets)
    return Prefix(data, 0).ranges(starts, ends), first


def piece_starts(n: int) -> list[int]:
    """Where the pieces begin by which an item of n words is searched; none of a short one."""
    if n < SHORT:
        return []
    return [0] if n <= LONG else [*range(0, n - PIECE, HOP), n - PIECE]


class Items:
    """The benchmark's items as word ids; id 0 is any other word."""

    def __init__(self, ids: list, texts: list[str]):
        data, offsets = flat(pa.array(texts, pa.string()))
        hashes, first = word_hashes(data, offsets)
        keep = np.flatnonzero(np.diff(first) > 0)
        self.names = [ids[i] for i in keep]
        self.vocabulary = np.unique(hashes)
        every = self.ids_of(hashes)
        self.words = [every[first[i] : first[i + 1]] for i in keep]
        self.pieces = [(i, a, w[a : a + PIECE] if len(w) > LONG else w) for i, w in enumerate(self.words) for a in piece_starts(len(w))]
        lengths = np.array([len(w) for _, _, w in self.pieces], np.int64)
        self.span = np.searchsorted(LENGTHS, lengths)

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def id_rows(docs: DataFrame, items, key: str, text: str) -> DataFrame:
    """(doc_id, print, ids): each text's word ids, packed as 32-bit integers."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            out = []
            for row, end in blocks(offsets):
                hashes, first = word_hashes(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
                ids = items.value.ids_of(hashes).astype("<u4")
                out += [ids[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "print", "ids"])

    body = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("print"), body).mapInArrow(run, f"doc_id {kind}, print bigint, ids binary")


def id_blocks(batch: pa.RecordBatch, column: int):
    """(first row, ids, first word of each text and the end) of runs of whole texts."""
    data, offsets = flat(batch.column(column))
    for row, end in blocks(offsets, 1 << 18):
        part = data[offsets[row] : offsets[end]]
        yield row, np.frombuffer(part.tobytes(), "<u4").astype(np.int64), (offsets[row : end + 1] - offsets[row]) // 4


def passages(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(word id, passage) of each word the benchmark uses; how many passages there are."""
    sizes = np.diff(first)
    count = -(-sizes // PASSAGE)
    base = np.cumsum(count) - count
    own = np.repeat(base, sizes) + (np.arange(len(ids)) - np.repeat(first[:-1], sizes)) // PASSAGE
    used = np.flatnonzero(ids)
    return ids[used], own[used], int(count.sum())


def latent_words(rows: DataFrame, n_words: int, spark) -> tuple[np.ndarray, np.ndarray]:
    """(latent vector, idf) of each word id, 0 for other words: idf times right singular vectors."""

    def count(batches):
        df = np.zeros((n_words + 1, 1))
        for batch in batches:
            for _, ids, first in id_blocks(batch, 0):
                used, own, n = passages(ids, first)
                pair = np.unique(own * (n_words + 1) + used) % (n_words + 1)
                df[:, 0] += np.bincount(pair, minlength=n_words + 1)
                df[0, 0] += n  # place 0 holds the number of passages
        return df

    ids = rows.select("ids")
    df = total_blocks(ids, count, n_words + 1, 1)[:, 0]
    idf = np.log((df[0] + 1) / (df + 1))
    idf[0] = 0
    wide = min(RANK + SPARE, n_words)
    start = np.random.default_rng(SEED).standard_normal((n_words + 1, wide)).astype(np.float32)
    given = spark.sparkContext.broadcast((idf.astype(np.float32), start))

    def project(batch, weighted):
        for _, ids, first in id_blocks(batch, 0):
            used, own, n = passages(ids, first)
            if len(used):
                yield used, own, sorted_sum(own, weighted[used], n)

    def reach(batches):  # A'(A start)
        weight, basis = given.value
        weighted, total = basis * weight[:, None], np.zeros(basis.shape)
        for batch in batches:
            for used, own, y in project(batch, weighted):
                order = np.argsort(used, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(used[order]) != 0]))
                total[used[order[heads]]] += np.add.reduceat(y[own[order]], heads, axis=0)
        return total * weight[:, None]

    basis, _ = np.linalg.qr(total_blocks(ids, reach, n_words + 1, wide))
    held = spark.sparkContext.broadcast((basis * idf[:, None]).astype(np.float32))

    def gram(batches):  # (A basis)'(A basis)
        one_thread()
        total = np.zeros((wide, wide))
        for batch in batches:
            for _, _, y in project(batch, held.value):
                total += y.T @ y
        return total

    values, turn = np.linalg.eigh(total_blocks(ids, gram, wide, wide))
    order = np.argsort(-values)
    order = order[values[order] > REAL * values.max(initial=0)]  # a corpus of few passages has few components; beyond is rounding noise
    kept = order[LEADING:RANK] if n_words > 4 * RANK and len(order) >= RANK else order[:RANK]  # a small benchmark or corpus has no such components
    return ((basis @ turn[:, kept]) * idf[:, None]).astype(np.float32), idf.astype(np.float32)


def common_subsequence(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence: bit-parallel over the item, whose words' places are in masks."""
    full = (1 << n) - 1
    row = full
    for word in other:
        if hit := masks.get(word):
            u = row & hit
            row = (row + u | row - u) & full
    return n - row.bit_count()


def places(ids: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, word in enumerate(ids.tolist()):
        out[word] = out.get(word, 0) | 1 << i
    return out


class Judge:
    """Finds the items that texts hold."""

    def __init__(self, items: Items, latent: np.ndarray, idf: np.ndarray):
        self.items, self.latent, self.idf = items, latent, idf
        parts = [w for _, _, w in items.pieces]
        vectors = np.array([latent[w].sum(0) for w in parts], np.float32).reshape(len(parts), latent.shape[1])
        self.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        self.weights = np.array([idf[w].sum() for w in parts])
        self.item = np.array([i for i, _, _ in items.pieces], np.int64)
        self.start = np.array([a for _, a, _ in items.pieces], np.int64)
        self.sizes = np.array([len(w) for w in items.words], np.int64)
        self.wide = len(items.vocabulary) + 1
        if len(parts) * self.wide <= CELLS:
            self.has = np.zeros((len(parts), self.wide), bool)
            for i, some in enumerate(parts):
                self.has[i, some] = True
        else:
            self.has = None
            self.cells = np.unique(np.concatenate([i * self.wide + w for i, w in enumerate(parts)]))
        self.masks: dict[int, dict[int, int]] = {}
        self.tails = [places(w[-ANSWER:]) for w in items.words]
        keys = [(word, i) for i in np.flatnonzero(self.sizes < SHORT).tolist() for word in self.rarest(items.words[i])]
        keys = np.array(sorted(set(keys)), np.int64).reshape(-1, 2)
        self.keyed = keys[:, 1]  # short items by rare word: of word w those from at[w] to at[w + 1]
        self.at = np.searchsorted(keys[:, 0], np.arange(self.wide + 1))

    def rarest(self, ids: np.ndarray) -> list[int]:
        """So many of a short item's rarest words that no text can hold it without one of them."""
        missing = len(ids) - int(np.ceil(PARAPHRASE * len(ids) - 1e-9))
        return ids[np.argsort(-self.idf[ids], kind="stable")[: missing + 1]].tolist()

    def holds(self, piece: np.ndarray, word: np.ndarray) -> np.ndarray:
        if self.has is not None:
            return self.has[piece, word]
        cell = piece * self.wide + word
        return self.cells[np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)] == cell

    def short_candidates(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, begin, end, item): the surroundings of short items' rare words."""
        count = self.at[ids + 1] - self.at[ids]
        word = np.flatnonzero(count)
        item = self.keyed[expand(self.at[ids[word]], count[word])]
        word = np.repeat(word, count[word])
        text, n = np.searchsorted(first, word, "right") - 1, self.sizes[item]
        return list(zip(text.tolist(), (word - 2 * n).tolist(), (word + 2 * n + 1).tolist(), item.tolist()))

    def candidates(self, ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, begin, end, item): surroundings of windows near an item or a piece of it by cosine that also share enough of its words."""
        sizes = np.diff(first)
        steps = -(-sizes // STEP)
        base = np.concatenate([[0], np.cumsum(steps)])
        used = np.flatnonzero(ids)
        if not len(used):
            return []
        out = self.short_candidates(ids, first) if len(self.keyed) else []
        text = np.repeat(np.arange(len(sizes)), sizes)[used]
        sums = sorted_sum(base[text] + (used - first[text]) // STEP, self.latent[ids[used]], int(base[-1]))
        owner = np.repeat(np.arange(len(sizes)), steps)
        left = base[owner + 1] - np.arange(len(owner))  # steps to the text's end
        vectors, long = sums.copy(), []
        for k, span in enumerate(SPANS):
            for step in range(1 if not k else SPANS[k - 1], span):
                vectors[: max(0, len(sums) - step)] += np.where((left > step)[: max(0, len(sums) - step), None], sums[step:], np.float32(0))
            mine = np.flatnonzero(self.items.span == k)
            if not len(mine):
                continue
            least = COSINE * np.maximum(np.linalg.norm(vectors, axis=1), 1e-6)
            for a in range(0, len(vectors), 4096):
                w, i = np.nonzero(vectors[a : a + 4096] @ self.vectors[mine].T >= least[a : a + 4096, None])
                if not len(w):
                    continue
                w, i = w + a, mine[i]
                low = first[owner[w]] + (w - base[owner[w]]) * STEP
                high = np.minimum(low + span * STEP, first[owner[w] + 1])
                word = ids[expand(low, high - low)]
                pair = np.repeat(np.arange(len(w)), high - low)
                share = np.bincount(pair, self.holds(i[pair], word) * self.idf[word], len(w))
                enough = share >= SHARED * self.weights[i]
                w, low, high, i = w[enough], low[enough], high[enough], i[enough]
                item, n = self.item[i], self.sizes[self.item[i]]
                piece = n > LONG
                out += zip(owner[w][~piece].tolist(), (low - n)[~piece].tolist(), (high + n)[~piece].tolist(), item[~piece].tolist())
                long += zip(owner[w][piece].tolist(), item[piece].tolist(), (low - self.start[i])[piece].tolist())
        last = (-1, -1, 0)
        for text, item, begin in sorted(long):  # where the item would begin; near ones are settled at once
            n = int(self.sizes[item])
            if (text, item) != last[:2] or begin > last[2] + n // 4:
                last = (text, item, begin)
                out.append((text, begin - n // 2, begin + n // 4 + n + n // 2 + LONG, item))
        return out

    def found(self, ids: np.ndarray, first: np.ndarray) -> dict[int, dict[int, float]]:
        """text -> item -> largest common share, of the items that the texts hold."""
        out: dict[int, dict[int, float]] = {}
        for text, begin, end, item in self.candidates(ids, first):
            n = len(self.items.words[item])
            if out.get(text, {}).get(item, 0.0) >= 1.0:
                continue
            around = ids[max(first[text], begin) : min(first[text + 1], end)].tolist()
            if item not in self.masks:
                self.masks[item] = places(self.items.words[item])
            share = common_subsequence(self.masks[item], n, around) / n
            tail = min(n, ANSWER)
            if share >= COPY or share >= PARAPHRASE and common_subsequence(self.tails[item], tail, around) >= ANSWER_SHARE * tail:
                have = out.setdefault(text, {})
                have[item] = max(share, have.get(item, 0.0))
        return out


def _round(docs: DataFrame, ids: list, texts: list[str], key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    items = Items(ids, texts)
    if not items.words:
        print_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
        return docs.select(F.col(key).alias("doc_id"), print_.alias("print"), F.array().cast("array<bigint>").alias("items"), F.lit(0.0).alias("share"))
    sent = spark.sparkContext.broadcast(items)
    rows = stage(id_rows(docs, sent, key, text), "ids")
    judge = spark.sparkContext.broadcast((items, *latent_words(rows, len(items.vocabulary), spark)))

    def run(batches):
        one_thread()
        known = Judge(*judge.value)
        for batch in batches:
            names, best = [[] for _ in range(len(batch))], [0.0] * len(batch)
            for row, ids, first in id_blocks(batch, 2):
                for k, found in known.found(ids, first).items():
                    names[row + k] = sorted(known.items.names[i] for i in found)
                    best[row + k] = max(found.values())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.int64())), pa.array(best, pa.float64())], ["doc_id", "print", "items", "share"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, print bigint, items array<bigint>, share double")


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Say of every document which items of the benchmark (item_id, text) it holds.

    Returns doc_id, print (hash of the text), items (their ids, sorted), share (largest part of an
    item found, 0 if none), contaminated. Items may have any number of words; one of less than SHORT
    words is held where its words stand within twice its length of one another. Null and empty texts hold nothing; items without words
    or null match nothing; repeated rows are judged alike; an empty benchmark leaves every
    document clean; other columns aren't read. The benchmark is taken in rounds of ITEM_BYTES.
    """
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = max(1, -(-int(size) // ITEM_BYTES))
    out = None
    for k in range(rounds):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k).where("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
        rows = part.collect()  # ITEM_BYTES of text on average
        found = _round(docs, [r[0] for r in rows], [r[1] for r in rows], key, text)
        out = found if out is None else out.unionAll(found)
    if rounds > 1:
        out = (
            out.withColumn("n", F.lit(1)).groupBy("doc_id", "print")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("share").alias("share"), (F.sum("n") / rounds).cast("int").alias("n"))
            .withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
        )
    return out.withColumn("contaminated", F.size("items") > 0)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of the table that hold no item, with all their columns, whatever these are called.

    Null and empty texts stay, holding nothing; rows equal in id and text stay or go together; an
    empty table stays empty, and an empty benchmark leaves every row.
    """
    return without_marks(docs, contamination(docs, benchmark).where("contaminated"))
