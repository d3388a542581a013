"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Texts become TF-IDF vectors over hashed terms: their words, the last byte of each word, and marks
for a word that repeats the one before or an earlier one of the text. Document frequencies are
counted over all texts; a truncated SVD of the labelled sample gives latent vectors. The
labelled vectors (a bounded sample) are broadcast; every text meets all of them in blocks of
exact cosine products, and the labels of the nearest vote with their similarities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesets import LOWER, Prefix, blocks, flat, words
from lexloom.llm.sums import sorted_sum, total_blocks
from lexloom.llm.threads import one_thread

#: Hashed words, then 256 last bytes, then the two marks.
WORDS = 1 << 15
REPEATS_LAST, SEEN, TERMS = WORDS + 256, WORDS + 257, WORDS + 258
#: At most so many labelled rows are fitted and broadcast; rank of the latent space; voting neighbours.
MAX_LABELLED, RANK, NEIGHBOURS = 4096, 48, 25
#: Power of the similarity in a vote; score from which a text is predicted to be good.
SHARPNESS, THRESHOLD = 8, 0.3


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count, words of each text), ordered by text and term."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = Prefix(data, 0).ranges(starts, ends)
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = len(sizes)
    # a word seen before in its text: not the first of its (text, hash)
    order = np.lexsort([hashes, text])
    seen = np.zeros(len(hashes), bool)
    seen[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    keys = np.concatenate([text * TERMS + (hashes >> np.uint64(49)).astype(np.int64), text * TERMS + WORDS + data[ends - 1], text[again] * TERMS + REPEATS_LAST, text[seen] * TERMS + SEEN])
    keys.sort()
    heads = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(keys)))
    return keys[heads] // TERMS, keys[heads] % TERMS, counts, sizes if n else np.zeros(0, np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Texts that hold each term, over the whole table, and as the last entry all texts."""

    def count(batches):
        out = np.zeros((TERMS + 1, 1))
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for row, end in blocks(offsets):
                _, term, _, sizes = term_counts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
                out[:TERMS, 0] += np.bincount(term, minlength=TERMS)
                out[TERMS, 0] += len(sizes)
        return out

    return total_blocks(texts, count, TERMS + 1, 1)[:, 0]


def truncated_svd(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, rank: int) -> np.ndarray:
    """Leading right singular vectors (TERMS x rank) of a sparse matrix in row order, by randomised subspace steps."""
    by_term = np.argsort(term, kind="stable")
    wide = rank + 8

    def times(x):  # A x
        out = np.zeros((n, wide), np.float32)
        for a in range(0, len(row), 1 << 17):
            part = slice(a, a + (1 << 17))
            out += sorted_sum(row[part], x[term[part]] * value[part, None], n)
        return out

    def back(y):  # A' y
        out = np.zeros((TERMS, wide), np.float32)
        for a in range(0, len(row), 1 << 17):
            part = by_term[a : a + (1 << 17)]
            out += sorted_sum(term[part], y[row[part]] * value[part, None], TERMS)
        return out

    basis = np.random.default_rng(11).standard_normal((TERMS, wide)).astype(np.float32)
    for _ in range(3):
        basis = np.linalg.qr(back(times(basis)))[0].astype(np.float32)
    y = times(basis)
    values, turn = np.linalg.eigh(y.T @ y)
    return (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


class Voters:
    """Labelled latent vectors; about 7 MB, whatever the corpus."""

    def __init__(self, weighted: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.weighted, self.vectors, self.labels = weighted, vectors, labels
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def latent(self, text, term, count, sizes) -> np.ndarray:
        value = np.sqrt(count / np.maximum(sizes, 1)[text]).astype(np.float32)
        out = sorted_sum(text, self.weighted[term] * value[:, None], len(sizes))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def scores(self, text, term, count, sizes) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest; the labels' mean for texts without words."""
        out = np.full(len(sizes), self.prior)
        if not len(self.labels):
            return out
        vectors = self.latent(text, term, count, sizes)
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(vectors), 256):
            near = vectors[a : a + 256] @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** SHARPNESS
            total = weight.sum(1)
            share = (weight * self.labels[best]).sum(1) / np.maximum(total, 1e-300)
            out[a : a + 256] = np.where((total > 0) & (sizes[a : a + 256] > 0), share, self.prior)
        return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Voters:
    """Fit on at most MAX_LABELLED of ``labels`` (key, label), picked by a hash of the key."""
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key).agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64(F.col(key)), key).limit(MAX_LABELLED)
    )

    def vectors(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            terms, counts = [], []
            for row, end in blocks(offsets):
                text_, term, count, sizes = term_counts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
                edge = np.searchsorted(text_, np.arange(len(sizes) + 1))
                terms += [term[a:b].astype("<i4").tobytes() for a, b in zip(edge, edge[1:])]
                counts += [np.append(count[a:b], s).astype("<i4").tobytes() for a, b, s in zip(edge, edge[1:], sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["key", "label", "terms", "counts"])

    df = document_frequencies(docs.select(text))
    idf = (1 + np.log((df[TERMS] + 1) / (df[:TERMS] + 1))).astype(np.float32)
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(picked), key).dropDuplicates([key]).select(F.col(key).cast("string"), "body", "label")
    sample = rows.mapInArrow(vectors, "key string, label double, terms binary, counts binary").collect()  # MAX_LABELLED sparse vectors
    sample.sort(key=lambda r: r.key)
    term = np.concatenate([np.frombuffer(r.terms, "<i4") for r in sample] or [np.zeros(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(sample)), [len(r.terms) // 4 for r in sample])
    counts = [np.frombuffer(r.counts, "<i4") for r in sample]
    count = np.concatenate([c[:-1] for c in counts] or [np.zeros(0, np.int32)])
    sizes = np.array([c[-1] for c in counts], np.int64)
    y = np.array([r.label for r in sample])
    if not len(term):
        return Voters(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    value = (np.sqrt(count / np.maximum(sizes, 1)[row]) * idf[term]).astype(np.float32)
    leading = truncated_svd(row, term, value, len(sample), min(RANK, len(sample)))
    voters = Voters(leading * idf[:, None], np.zeros((0, 1)), y)
    voters.vectors = voters.latent(row, term, count, sizes)
    return voters


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Score every whole text of the table.

    Returns doc_id, score (0 to 1), predicted (1 if score >= THRESHOLD). Only texts and the given
    labels enter a score. Null and empty texts get the mean of the labels, without labels every text
    gets 0.5; labels that are null are left out, of several for one key the largest holds; repeated
    rows score alike; other columns aren't read.
    """
    voters = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label))

    def run(batches):
        one_thread()
        for batch in batches:
            data, offsets = flat(batch.column(1))
            out = [voters.value.scores(*term_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]
            out = np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
