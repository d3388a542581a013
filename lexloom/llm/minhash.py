"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A sketch has BINS coordinates. In round i every shingle throws itself into one bin, with
a value that grows with the round, and a bin keeps its least value; rounds go on until every
bin is filled, and from round BINS on the bins are filled in turn, so 2 * BINS rounds always
do. Equal coordinates estimate the Jaccard similarity with concentration, for small sets too.
Documents with equal sets form a class; classes that share a band are candidates; each
candidate is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.bytesets import LOWER, Prefix, blocks, flat, mix, words
from lexloom.llm.graph import components
from lexloom.llm.rows import with_marks
from lexloom.llm.staging import stage

#: 24 bands of 4 coordinates: a pair of similarity 0.8 shares none with probability 3e-6.
BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
#: Coordinates of the finer sketch by which large buckets are searched, and how far below the
#: threshold (in standard deviations) its estimate may be.
FINE, SIGMAS = 512, 4.5
#: At most so many nodes are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shingles of a strip (nodes left over) and of a piece (nodes compared with) at most when a group is searched.
STRIP, PIECE = 1_000_000, 2_000_000
#: A group is dealt into so many strips and pieces at least, unless these would have less than SMALL shingles.
PARTS, SMALL = 16, 1 << 13

U = np.uint64
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct word shingles of each document, sorted, one after another."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    prefix = Prefix(Prefix(data, 0).ranges(starts, ends), 1)
    sets = []
    every = prefix.windows(size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            sets.append(prefix.ranges(np.array([a]), np.array([b])))
        else:
            sets.append(every[:0])
    return (np.concatenate(sets) if sets else every[:0]), np.array([len(s) for s in sets], np.int64)


def sketches(hashes: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates for each set; an empty set keeps EMPTY everywhere."""
    n = len(counts)
    table = np.full(n * bins, EMPTY)
    owner = np.repeat(np.arange(n), counts)
    live = hashes
    for turn in range(2 * bins):
        if not len(live):
            break
        value = mix(live + U((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        place = owner * bins + ((value >> U(32)) % U(bins)).astype(np.int64) if turn < bins else owner * bins + turn - bins
        np.minimum.at(table, place, U(turn) << U(54) | value >> U(10))
        unfilled = (table.reshape(n, bins) == EMPTY).any(1)
        keep = unfilled[owner]
        live, owner = live[keep], owner[keep]
    return table.reshape(n, bins)


def sketch_rows(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """doc_id, print (hash of the text), n_shingles, first and second (fingerprints of the set), bands."""

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(2))
            out = [[], [], [], []]
            for row, end in blocks(offsets):
                hashes, counts = shingle_sets(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], size)
                table = sketches(hashes, counts, BINS).reshape(-1, BANDS, ROWS)
                bands = np.zeros(table.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0x632BE59BD9B4E019)
                for k in range(ROWS):
                    bands = mix(bands ^ table[:, :, k])
                full = counts > 0
                first, second = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
                if full.any():
                    heads = (np.cumsum(counts) - counts)[full]
                    first[full] = np.add.reduceat(mix(hashes + U(1)), heads)
                    second[full] = np.bitwise_xor.reduceat(mix(hashes ^ U(0xD6E8FEB86659FD93)), heads)
                for column, values in zip(out, (counts, first, second, bands)):
                    column.append(values)
            counts, first, second, bands = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(counts) * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists], ["doc_id", "print", "n_shingles", "first", "second", "bands"])

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("print"), body).mapInArrow(run, "doc_id bigint, print bigint, n_shingles bigint, first bigint, second bigint, bands array<bigint>")


def node_name() -> Column:
    """The name of a class: 63 bits of its fingerprints, so rows with and without an id are named alike."""
    return F.xxhash64("first", "second", "n_shingles").bitwiseAND((1 << 63) - 1)


def set_rows(docs: DataFrame, nodes: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes' own rows: sorted 64-bit hashes, packed. nodes: (node, doc_id, print).

    Of rows equal in id and text a task reads one.
    """

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            data, offsets = flat(batch.column(1))
            blobs = []
            for row, end in blocks(offsets):
                hashes, counts = shingle_sets(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], size)
                edge = np.concatenate([[0], np.cumsum(counts)])
                blobs += [hashes[edge[k] : edge[k + 1]].tobytes() for k in range(end - row)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["node", "shingles"])

    count = nodes.count()
    wanted = F.broadcast(nodes) if count <= BROADCAST_IDS else nodes
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(body).alias("body_print"), body.alias("body"))
    own = rows.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("body_print") == F.col("print")))
    return own.select("node", "body").mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union of their whole sets."""

    def run(batches):
        for batch in batches:
            good = []
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    good.append(i)
            where = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where)], ["u", "v"])

    left = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    whole = left.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    return whole.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def search_groups(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the nodes left over in each group.

    rows: (group, node, n, label, left, strips, pieces). Nodes left over are dealt into strips of
    their group and meet all of the group, a piece at a time, so a task holds a bounded part of
    it. There a fine sketch rules out partners, nearest ones are verified on the whole sets first,
    and one link to a label makes the label's other members needless. Only links come out.
    """
    least = percent / 100 - SIGMAS * (percent / 100 * (1 - percent / 100) / FINE) ** 0.5

    def fine(batches):
        for batch in batches:
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            counts = np.array([len(s) for s in sets_], np.int64)
            blobs, edge = [], np.concatenate([[0], np.cumsum(counts + FINE)])  # a sketch takes room too
            for row, end in blocks(edge, 1 << 19):
                table = sketches(np.concatenate(sets_[row:end]), counts[row:end], FINE)
                blobs += [x.tobytes() for x in (mix(table) & U(255)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["node", "shingles", "sketch"])

    def compare(table):
        node, n, label, asks = (table.column(c).to_numpy() for c in ("node", "n", "label", "asks"))
        grid = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, FINE)
        whole = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        u, v, build = [], [], np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            fit = build[(label[build] != label[i]) & (100 * n[build] >= percent * n[i]) & (100 * n[i] >= percent * n[build])]
            near = np.concatenate([(grid[fit[k : k + 4096]] == grid[i]).mean(1) for k in range(0, len(fit), 4096)]) if len(fit) else np.zeros(0)
            met = set()
            for k in np.argsort(-near, kind="stable"):
                if near[k] < least:
                    break
                j = fit[k]
                if label[j] not in met:
                    both = len(np.intersect1d(whole[i], whole[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        met.add(label[j])
                        u.append(min(node[i], node[j]))
                        v.append(max(node[i], node[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    spread = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    at = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    columns = ["group", "strip", "piece", "node", "n", "label", "asks"]
    asks = rows.where("left").withColumn("strip", at("strips")).withColumn("piece", spread("pieces")).withColumn("asks", F.lit(True))
    answers = rows.withColumn("piece", at("pieces")).withColumn("strip", spread("strips")).withColumn("asks", F.lit(False))
    sketched = sets.join(rows.select("node").distinct(), "node", "left_semi").mapInArrow(fine, "node bigint, shingles binary, sketch binary")
    dealt = asks.select(columns).unionByName(answers.select(columns))
    return dealt.join(sketched, "node").groupBy("group", "strip", "piece").applyInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose sets of ``size``-word shingles have Jaccard similarity percent/100 or more.

    Returns doc_id, print (hash of the text), n_shingles, component_id (smallest id that can be
    reached, itself included), kept (doc_id = component_id). A-Z are lower-cased. A text with fewer words than a shingle is
    one shingle; null texts, empty texts and texts without words have none and are linked with
    nothing. Rows of one id are one document for linking, whatever their texts, and each keep their
    row; rows without an id belong to a component as any do, and where it has no id at all it is
    null and the rows of one of its texts (the least print) are kept. Ids are read as long integers.
    Other columns aren't read.

    Equal sets are one class from the start, so a group of copies makes one row. In each band's
    bucket the classes are compared with its most central one, the one in the largest buckets;
    what stays unlinked is searched by a finer sketch. No pair list of a bucket is made.
    """
    found = stage(sketch_rows(docs, size, key, text), "sketches")
    # a class's own row is one with its least id, if it has one
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "print")
    classes = stage(
        found.where("n_shingles > 0").groupBy("first", "second", "n_shingles")
        .agg(F.min(own).alias("own"), F.min("print").alias("least_print"), F.first("bands").alias("bands"))
        .select("first", "second", "n_shingles", "own.doc_id", "own.print", "least_print", node_name().alias("node"), "bands"),
        "classes",
    )
    banded = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    banded = stage(banded.join(shared, "band"), "bands")
    central = banded.groupBy("node").agg(F.sum("m").alias("pop"))
    hubs = (
        banded.join(central, "node").groupBy("band")
        .agg(F.max(F.struct("pop", (-F.col("node")).alias("minus"), "n")).alias("top"))
        .select("band", (-F.col("top.minus")).alias("hub"), F.col("top.n").alias("hub_n"))
    )
    hubs = stage(hubs, "hubs")
    fits = lambda a, b: (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))
    pairs = (
        banded.join(hubs, "band").where((F.col("hub") != F.col("node")) & fits("n", "hub_n"))
        .select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    )
    pairs = stage(pairs, "pairs")
    nodes = stage(banded.select("node").distinct().join(classes.select("node", "doc_id", "print"), "node").dropDuplicates(["node"]), "nodes")
    sets = stage(set_rows(docs, nodes, size, key, text), "sets")
    ids = found.where("doc_id is not null and n_shingles > 0").select("doc_id", node_name().alias("v"))
    several = ids.groupBy("doc_id").agg(F.min("v").alias("u"), F.max("v").alias("most")).where("u < most").drop("most")
    same_id = ids.join(several, "doc_id").where("u < v").select("u", "v").distinct()
    edges = stage(verify(pairs, sets, percent).union(same_id), "links")
    labels = components(edges)

    named = banded.select("band", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hub_names = hubs.join(labels, hubs.hub == labels.node, "left").select("band", F.coalesce("label", "hub").alias("group"))
    both = named.join(hub_names, "band").select("group", "node", "n", "label", (F.col("label") != F.col("group")).alias("left")).distinct()
    sized = both.groupBy("group").agg(F.sum(F.when(F.col("left"), F.col("n"))).alias("over"), F.sum("n").alias("all")).where("over > 0")
    deal = lambda total, most: F.ceil(F.col(total) / F.greatest(F.lit(SMALL), F.least(F.lit(most), F.col(total) / PARTS))).cast("long")
    rows = both.join(sized.select("group", deal("over", STRIP).alias("strips"), deal("all", PIECE).alias("pieces")), "group")
    more = stage(search_groups(stage(rows, "groups"), sets, percent), "links")
    if more.limit(1).count():
        labels = components(edges.union(more))

    linked = classes.select("node", "doc_id", "least_print").join(labels, "node")
    heads = linked.groupBy("label").agg(F.min("doc_id").alias("least_id"), F.min("least_print").alias("head"))
    names = linked.select("node", "label").join(heads, "label").drop("label")
    alone = F.col("head").isNull()  # a class without links
    named = classes.join(names, "node", "left").select(
        "first", "second", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component"), F.coalesce("head", "least_print").alias("head"),
    )
    out = found.drop("bands").join(named, ["first", "second", "n_shingles"], "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    kept = F.col("doc_id").eqNullSafe(component) & (component.isNotNull() | F.col("head").isNull() | (F.col("print") == F.col("head")))
    return out.select("doc_id", "print", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of the table that ``near_duplicates`` keeps, with all their columns, whatever these are called.

    Null and empty texts stay, being near to nothing; rows equal in id and text stay or go
    together; an empty table stays empty.
    """
    return with_marks(docs, near_duplicates(docs).where("kept"))
