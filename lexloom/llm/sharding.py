"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A tree has regions, racks in regions and shards in racks; a node weighs what its
shards weigh. A row descends from the root: at each level every child draws
-ln(u) / weight from the hash of (key, child), and the least draw wins, so a
child wins in proportion to its weight. If weights change below one subtree,
only rows that enter or leave that subtree move. A shard added as a region of
its own therefore takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.staging import parts_for, stage

#: A tree is a list of (region, rack, shard number, weight).
Tree = list[tuple[str, str, int, float]]


def even_tree(n_shards: int, racks: int = 2, per_rack: int = 2) -> Tree:
    """Shards 0.. of weight 1, filled region by region."""
    each = racks * per_rack
    return [(f"region{i // each}", f"rack{i % each // per_rack}", i, 1.0) for i in range(n_shards)]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region."""
    n = max(i for *_, i, _ in tree) + 1
    return [*tree, (f"region+{n}", "rack0", n, weight)]


def _choose(key: Column, path: str, children: dict[str, float]) -> Column:
    """Index of the child with the least weighted draw."""
    if len(children) == 1:
        return F.lit(0)
    draws = []
    for i, (name, weight) in enumerate(sorted(children.items())):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{path}/{name}"), key), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(i).alias("i")))
    return F.array_min(F.array(*draws)).getField("i")


def _descend(key: Column, path: str, nodes: list[tuple]) -> Column:
    """Shard number below ``path``; nodes: (rest of the path..., shard number, weight)."""
    weights: dict[str, float] = {}
    for name, *_, weight in nodes:
        weights[str(name)] = weights.get(str(name), 0.0) + weight
    names = sorted(weights)
    below = [[node[1:] for node in nodes if str(node[0]) == name] for name in names]
    leaf = [F.lit(int(name)) if len(rest[0]) == 1 else _descend(key, f"{path}/{name}", rest) for name, rest in zip(names, below)]
    if len(names) == 1:
        return leaf[0]
    pick = _choose(key, path, weights)
    out = F.when(pick == 0, leaf[0])
    for i in range(1, len(names)):
        out = out.when(pick == i, leaf[i])
    return out


def tree_shard(key: Column, tree: Tree) -> Column:
    """Shard number of each row by its key. A null key is a key like any other."""
    return _descend(F.coalesce(key.cast("string"), F.lit("\x00null")), "", list(tree)).cast("int")


def shard_rows(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard and number the rows of each shard from 0 without gaps.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard (the shard with
    one more of them). Null and empty texts have size 1 and checksum 0; repeated rows go to one
    shard and get slots of their own; an empty table gives an empty result; other columns are
    not read. Slots are counted in bins of a shard, dealt by row, so no shard, key or group of
    equal texts is numbered in one task: only the bins' counts are summed up.
    """
    tree = even_tree(n_shards)
    body = F.coalesce(F.col(text), F.lit(""))
    bins = parts_for(docs)
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        tree_shard(F.col(key), tree).alias("shard"),
        tree_shard(F.col(key), grow(tree)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(bins)))
    slim = stage(slim, "shards")
    counts = slim.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bin", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bin").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "row")
    return (
        slim.withColumn("at", F.row_number().over(order))
        .join(starts, ["shard", "bin"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"), "grown_shard")
    )
