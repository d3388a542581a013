"""Tensor operators on array columns: linear maps, norms, attention, losses, updates."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def given(x: Column, make) -> Column:
    """make(x) with ``x`` worked out once: Catalyst copies an expression to wherever it is used, also into loops over arrays."""
    return F.get(F.transform(F.array(x), make), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """``x`` times 10**digits, half away from zero, divided again, as in DuckDB and C: zero keeps its sign.

    Spark's own ``round`` goes by the shortest decimal of a number and has no negative zero.
    """
    unit = float(10**digits)

    def scaled(x):
        def near(y):
            down = F.floor(y).cast("double")
            whole = F.when(y < float(1 << 52), down + F.when(y - down >= 0.5, 1.0).otherwise(0.0)).otherwise(y)
            return F.when(y == float("inf"), x).otherwise(F.signum(x) * (whole / unit))

        return given(F.abs(x * unit), near)

    return given(x, scaled)


def linear(x: Column, weights: Column, bias: Column | None = None) -> Column:
    """x W' + b; weights: an array of rows."""
    out = given(x, lambda v: F.transform(weights, lambda row: dot(v, row)))
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)


def layer_norm(x: Column, eps: float = 1e-5, gain: Column | None = None, bias: Column | None = None) -> Column:
    """Zero mean and unit (biased) variance, then gain and bias by coordinate if they are given."""
    add = lambda s, v: s + v

    def scaled(x):
        n = F.size(x).cast("double")
        mean = F.aggregate(x, F.lit(0.0), add) / n
        square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n
        facts = F.struct(mean.alias("mean"), square.alias("square"))
        scale = lambda f: F.sqrt(f.getField("square") - f.getField("mean") * f.getField("mean") + eps)
        return given(facts, lambda f: F.transform(x, lambda v: (v - f.getField("mean")) / scale(f)))

    out = given(x, scaled)
    if gain is not None:
        out = F.zip_with(out, gain, lambda a, b: a * b)
    return out if bias is None else F.zip_with(out, bias, lambda a, b: a + b)


def softmax(x: Column) -> Column:
    def shares(x):
        powers = given(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
        total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
        return given(powers, lambda p: given(total(p), lambda t: F.transform(p, lambda v: v / t)))

    return given(x, shares)


def gelu(x: Column) -> Column:
    """Gaussian error linear unit with the polynomial error function of Abramowitz and Stegun 7.1.26."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.signum(x) * (F.lit(1.0) - poly * F.exp(-z * z))
    return x * 0.5 * (F.lit(1.0) + erf)


def feed_forward(x: Column, up: Column, down: Column, up_bias: Column | None = None, down_bias: Column | None = None) -> Column:
    """Two linear maps with a GELU between them."""
    return linear(F.transform(linear(x, up, up_bias), gelu), down, down_bias)


def embed(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc, place, id, v): the vector of every id of (doc, ids); (id, v) is a vocabulary's table."""
    return ids.select("doc", F.posexplode("ids").alias("place", "id")).join(vectors, "id").select("doc", "place", "id", "v")


def add_positions(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Add the vector p of each row's pos to v; (pos, p) has a context window's rows."""
    return rows.join(places, "pos").withColumn("v", F.zip_with("v", "p", lambda a, b: a + b)).drop("p")


def draw(p: Column, u: Column) -> Column:
    """The first place (from 0) whose running sum is over u; the last if rounding leaves none."""
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["at"] + F.when(s["sum"] + x > u, 0).otherwise(1)).alias("at"))
    at = F.aggregate(p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), step)["at"]
    return F.least(at, F.size(p) - 1)


def split_heads(x: Column, heads: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.slice(x, h * width + 1, F.lit(width)))


def causal_attention(rows: DataFrame, width: int) -> DataFrame:
    """(seq, pos, out) of (seq, pos, v): single-head attention with identity projections."""
    return attend(rows.select("seq", "pos", F.col("v").alias("q"), F.col("v").alias("k"), "v"), width)


def attend(rows: DataFrame, width: int) -> DataFrame:
    """(seq, pos, out) of (seq, pos, q, k, v): every place weighs the values up to its own.

    A sequence joins itself on its key with k <= q; sequences are as long as a context window.
    """
    asks, keys = rows.select("seq", "pos", "q"), rows.select("seq", F.col("pos").alias("kpos"), "k", "v")
    pairs = asks.join(keys, "seq").where("kpos <= pos")
    scored = pairs.select("seq", "pos", "kpos", (dot(F.col("q"), F.col("k")) / F.lit(float(width) ** 0.5)).alias("s"), F.col("v").alias("kv"))
    grouped = scored.groupBy("seq", "pos").agg(F.sort_array(F.collect_list(F.struct("kpos", "s", "kv"))).alias("a"))
    weighted = grouped.select("seq", "pos", "a", softmax(F.transform("a", lambda a: a.getField("s"))).alias("w"))
    zero = F.array_repeat(F.lit(0.0), width)
    mix = F.aggregate(F.zip_with("a", "w", lambda a, w: F.transform(a.getField("kv"), lambda v: v * w)), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return weighted.select("seq", "pos", mix.alias("out"))


def matrix(values: list) -> Column:
    """A constant array of rows, or of numbers, folded into one literal of the plan."""
    kind = "array<array<double>>" if values and isinstance(values[0], list) else "array<double>"
    return F.from_json(F.lit(json.dumps(values)), kind)


def multi_head_attention(rows: DataFrame, weights: dict[str, list], heads: int) -> DataFrame:
    """(seq, pos, out) of (seq, pos, x): causal attention of ``heads`` heads between four linear maps.

    weights: ``q.w``, ``q.b``, and so for k, v and o; a missing bias is none. Projections run row by
    row; a head of a sequence is what is joined, so heads are dealt like sequences.
    """
    wide = len(weights["q.w"])
    if wide % heads:
        raise ValueError("the width must be divisible by the number of heads")
    width = wide // heads
    project = lambda name, x: linear(x, matrix(weights[f"{name}.w"]), matrix(weights[f"{name}.b"]) if f"{name}.b" in weights else None)
    cut = [split_heads(project(name, F.col("x")), heads, width).alias(name) for name in "qkv"]
    each = rows.select("seq", "pos", F.posexplode(F.arrays_zip(*cut)).alias("head", "h")).select(F.struct("seq", "head").alias("seq"), "pos", "h.q", "h.k", "h.v")
    done = attend(each, width).groupBy("seq.seq", "pos").agg(F.sort_array(F.collect_list(F.struct("seq.head", "out"))).alias("a"))
    return done.select("seq", "pos", project("o", F.flatten(F.transform("a", lambda a: a.getField("out")))).alias("out"))


def transformer_block(rows: DataFrame, weights: dict[str, list], heads: int) -> DataFrame:
    """(seq, pos, out) of (seq, pos, x): pre-norm attention and feed-forward, each added to its input.

    weights: those of ``multi_head_attention``, ``ln1.g``, ``ln1.b``, ``ln2.g``, ``ln2.b``, ``up.w``, ``up.b``, ``down.w``, ``down.b``.
    """
    norm = lambda name, x: layer_norm(x, gain=matrix(weights[f"{name}.g"]), bias=matrix(weights[f"{name}.b"]))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    mixed = multi_head_attention(rows.select("seq", "pos", norm("ln1", F.col("x")).alias("x")), weights, heads)
    middle = rows.join(mixed, ["seq", "pos"]).select("seq", "pos", plus("x", "out").alias("x"))
    pushed = feed_forward(norm("ln2", F.col("x")), matrix(weights["up.w"]), matrix(weights["down.w"]), matrix(weights["up.b"]), matrix(weights["down.b"]))
    return middle.select("seq", "pos", plus("x", pushed).alias("out"))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """(seq, token, logit) of the k largest of each seq; ties at the k-th stay."""
    return logits.withColumn("r", F.rank().over(Window.partitionBy("seq").orderBy(F.desc("logit")))).where(F.col("r") <= k).drop("r")


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax of the target place (from 0)."""
    top = F.array_max(logits)
    return F.log(F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top - F.get(logits, target)


def clip_scale(norm: Column, limit: float) -> Column:
    return F.when(norm > limit, F.lit(limit) / (norm + 1e-6)).otherwise(F.lit(1.0))


def adamw(p: Column, g: Column, m: Column, v: Column, step: int, rate: float = 3e-4, decay: float = 0.1, betas=(0.9, 0.95), eps: float = 1e-8) -> Column:
    """struct(p, m, v) after one decoupled update."""
    rest = lambda b, n: float(1 - Decimal(str(b)) ** n)  # noqa: E731  1 - 0.9 is not 0.1 in floats
    m1, v1 = m * betas[0] + rest(betas[0], 1) * g, v * betas[1] + rest(betas[1], 1) * g * g
    move = rate * (m1 / rest(betas[0], step)) / (F.sqrt(v1 / rest(betas[1], step)) + eps)
    return F.struct((p * (1 - rate * decay) - move).alias("p"), m1.alias("m"), v1.alias("v"))
