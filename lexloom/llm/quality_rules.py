"""Quality rules: robust multivariate outliers among documents, in DataFrame expressions only.

Each document has a vector of transformed statistics. For every (language, source) the
minimum-covariance-determinant estimate of their centre and scatter is found by
concentration steps: take the half or more of the documents nearest to the present
estimate, re-estimate from them, repeat until nothing moves, from three starts. Documents
whose Mahalanobis distance is beyond a chi-square cut are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.rows import with_marks
from lexloom.llm.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Share of the documents that an estimate rests on; concentration steps; documents that a group has at least.
SHARE, STEPS, LEAST = 0.75, 12, 60
#: Fall of the log determinant that still counts as a move.
SETTLED = 1e-3
#: Tables of up to so many groups (21 numbers each) are broadcast; of larger ones every group is dealt into SALTS parts.
MOST_GROUPS, SALTS = 20_000, 32
#: Quantiles are counted in bins: floors are BINS wide, and so is a distance that grows e-fold; smaller squared distances than NEAREST are alike.
BINS, NEAREST = 32, 1e-3
#: Unit of the fixed-point sums.
FIXED = float(1 << 20)
#: Chance of rejecting a document of a normal population, before the floors make it smaller still.
TAIL = 1e-8
#: Transformed statistics, with the least standard deviation that is believed of each: where
#: clean documents all agree (no symbols, no repeats), the scatter would be singular.
FLOORS = {"log_words": 1.0, "log_word_length": 0.15, "log_symbols": 0.25, "repeated_share": 0.1, "double_line_share": 0.2}
DIM = len(FLOORS)


def chi_square_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, k) < p else (low, middle)
    return high


#: Scatter of the nearest SHARE of a normal population, made consistent; the cut.
CONSISTENT = SHARE / chi_square_cdf(chi_square_quantile(SHARE, DIM), DIM + 2)
CUT = chi_square_quantile(1 - TAIL, DIM)


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")
    base = docs.select(*keep, body.alias("_body"), words.alias("_w"))
    lines = F.filter(F.split("_body", "\n"), lambda line: line.rlike(WORD))
    hashed = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    n = F.size("_h")
    at = lambda i: F.get("_h", i)
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4))))
    windowed = hashed.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_v"))
    # equal windows stand side by side once sorted; most texts have none and skip this
    twice = F.col("_v").isNotNull() & (F.size(F.array_distinct("_v")) < F.size("_v"))
    ordered = F.when(twice, F.sort_array(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i")))))
    sorted_ = windowed.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", ordered.alias("_s"))
    same = lambda s, i, j: F.get("_s", j).getField("v") == s.getField("v")
    again = F.filter("_s", lambda s, i: F.coalesce(same(s, i, i + 1), F.lit(False)) | F.coalesce(same(s, i, i - 1), F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda s: s.getField("i")))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-5).alias("last"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc.getField("sum") + F.least(F.lit(5), i - acc.getField("last"))).alias("sum")),
        lambda acc: acc.getField("sum"),
    )
    return sorted_.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics, in the order of FLOORS."""
    c = F.col
    return {
        "log_words": F.log(c("n_words") + 1.0),
        "log_word_length": F.log((c("word_chars") + 5.0) / (c("n_words") + 1.0)),
        "log_symbols": F.log(1.0 + 100.0 * c("n_symbols") / (c("word_chars") + 1.0)),
        "repeated_share": c("n_repeat_words") / (c("n_words") + 1.0),
        "double_line_share": c("n_dup_lines") / (c("n_dup_lines") + 10.0),
    }


def _inverse_factor(estimates: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """(keys, more, m{i}, w{i}_{j}, volume): rows of the inverse Cholesky factor of c{i}_{j}, and the log determinant."""
    out = estimates
    for j in range(DIM):  # a column of the factor, its diagonal first
        rest = lambda i: F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j), F.lit(1e-12))))
        if j + 1 < DIM:
            out = out.withColumns({f"l{i}_{j}": rest(i) / F.col(f"l{j}_{j}") for i in range(j + 1, DIM)})
    for step in range(DIM):  # a diagonal of the inverse
        below = lambda i, j: -sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}_{i}")
        out = out.withColumns({f"w{j + step}_{j}": below(j + step, j) if step else 1.0 / F.col(f"l{j}_{j}") for j in range(DIM - step)})
    volume = sum((2.0 * F.log(f"l{i}_{i}") for i in range(DIM)), F.lit(0.0))
    return out.select(*keys, *more, *[f"m{i}" for i in range(DIM)], *[f"w{i}_{j}" for i in range(DIM) for j in range(i + 1)], volume.alias("volume"))


def _distance() -> Column:
    """Squared Mahalanobis distance of (x0..) to the joined estimate."""
    total = F.lit(0.0)
    for i in range(DIM):
        y = sum((F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _floor2(i: int) -> float:
    return list(FLOORS.values())[i] ** 2


def _width(i: int) -> float:
    return list(FLOORS.values())[i] / BINS


def _distance_bin() -> Column:
    """Bin of a squared distance: the rank by which documents are near, in steps of 1 / BINS of its logarithm."""
    return F.floor(F.log(F.col("d") + NEAREST) * BINS)


def _exact_sum(value: Column) -> Column:
    """A sum in fixed point, the same in whatever order partitions come."""
    return F.sum(F.round(value * FIXED).cast("long")) / FIXED


def _moments(values: list[Column], name: str) -> list[Column]:
    """Means {name}{i} and scatters {name}{i}_{j} of the values, as aggregates."""
    n = F.count("*")
    mean = [_exact_sum(v) / n for v in values]
    pairs = [(i, j) for i in range(DIM) for j in range(i + 1)]
    return [*[m.alias(f"{name}{i}") for i, m in enumerate(mean)], *[(_exact_sum(values[i] * values[j]) / n - mean[i] * mean[j]).alias(f"{name}{i}_{j}") for i, j in pairs]]


def _quantile_bins(counted: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, b0, b1, ...): of each group of (keys, bin, n) the first bin up to which there are so many rows."""
    order = Window.partitionBy(*keys)
    up_to = counted.select(*keys, "bin", F.sum("n").over(order.orderBy("bin")).alias("c"), F.sum("n").over(order).alias("t"))
    return up_to.groupBy(*keys).agg(*[F.min(F.when(F.col("c") >= F.ceil(F.col("t") * share), F.col("bin"))).alias(f"b{k}") for k, share in enumerate(shares)])


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Join rows (with a salt) to their group's row: by broadcast if there are few groups, else every group is dealt into SALTS parts."""
    if few:
        return rows.join(F.broadcast(groups), keys, how)
    return rows.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "salt"], how)


def starting_points(vectors: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """(keys, start, m{i}, c{i}_{j}): three deterministic starts of each group.

    0: medians and quartile spreads; 1: medians and the scatter of tanh of the scaled values, which
    bounds what far rows weigh; 2: mean and scatter of all rows.
    """
    each = vectors.select(*keys, F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / _width(i)) for i in range(DIM)])).alias("i", "bin"))
    cuts = _quantile_bins(each.groupBy(*keys, "i", "bin").agg(F.count("*").alias("n")), [*keys, "i"], [0.25, 0.5, 0.75])
    at = lambda b, i: F.max(F.when(F.col("i") == i, (F.col(b) + 0.5) * _width(i)))
    scale = lambda i: F.sqrt(F.pow((at("b2", i) - at("b0", i)) / 1.349, F.lit(2.0)) + _floor2(i))
    middle = cuts.groupBy(*keys).agg(*[at("b1", i).alias(f"q{i}") for i in range(DIM)], *[scale(i).alias(f"s{i}") for i in range(DIM)])
    middle = stage(middle, "medians")
    away = [F.col(f"x{i}") - F.col(f"q{i}") for i in range(DIM)]
    joined = with_groups(vectors, middle, keys, few)
    first = lambda c: F.first(c).alias(c)
    facts = joined.groupBy(*keys).agg(
        *[first(f"q{i}") for i in range(DIM)], *[first(f"s{i}") for i in range(DIM)],
        *_moments(away, "a"), *_moments([F.tanh(away[i] / F.col(f"s{i}")) for i in range(DIM)], "h"),
    )
    c = F.col
    diagonal = lambda i, j, value: value if i == j else F.lit(0.0)
    makers = [
        (lambda i: c(f"q{i}"), lambda i, j: diagonal(i, j, c(f"s{i}") * c(f"s{i}"))),
        (lambda i: c(f"q{i}"), lambda i, j: c(f"s{i}") * c(f"s{j}") * c(f"h{i}_{j}") + diagonal(i, j, F.lit(_floor2(i)))),
        (lambda i: c(f"q{i}") + c(f"a{i}"), lambda i, j: c(f"a{i}_{j}") + diagonal(i, j, F.lit(_floor2(i)))),
    ]
    structs = [F.struct(F.lit(k).alias("start"), *[m(i).alias(f"m{i}") for i in range(DIM)], *[s(i, j).alias(f"c{i}_{j}") for i in range(DIM) for j in range(i + 1)]) for k, (m, s) in enumerate(makers)]
    return facts.select(*keys, F.explode(F.array(*structs)).alias("e")).select(*keys, "e.*")


def estimate(vectors: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """Minimum-covariance-determinant estimate of each group: centre m{i} and inverse factor w{i}_{j}.

    From each start, concentration steps go on until the determinant falls no more (STEPS at most);
    of the starts the one with the least determinant is taken. A step keeps the nearest SHARE of the
    group, whole bins of the distance at a time, so it counts and sums in exact integers and comes out
    alike however rows are dealt. vectors: (keys, x{i}, salt).

    ``few``: the groups are counted and with their starts no more than MOST_GROUPS; their rows are
    then sent to every task, so that the steps move partial aggregates alone.
    """
    own = [*keys, "start"]
    begin = starting_points(vectors, keys, few).withColumn("moved", F.lit(True))
    now = stage(_inverse_factor(begin, own, ["moved"]), "scatter")
    numbers = [f"x{i}" for i in range(DIM)]
    for _ in range(STEPS):
        far = with_groups(vectors, now.where("moved").drop("moved"), keys, few).select(*own, "salt", *numbers, *[f"m{i}" for i in range(DIM)], "volume", _distance().alias("d"))
        far = far.withColumn("bin", _distance_bin())
        near = _quantile_bins(far.groupBy(*own, "bin").agg(F.count("*").alias("n")), own, [SHARE])
        kept = with_groups(far, near, own, few).where("bin <= b0")
        sums = kept.groupBy(*own).agg(
            *[F.first(f"m{i}").alias(f"o{i}") for i in range(DIM)], F.first("volume").alias("before"),
            *_moments([F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)], "a"),
        )
        scatter = sums.select(
            *own, "before",
            *[(F.col(f"o{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(DIM)],
            *[(F.col(f"a{i}_{j}") * CONSISTENT + (_floor2(i) if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(DIM) for j in range(i + 1)],
        )
        after = _inverse_factor(scatter, own, ["before"])
        moved = after.withColumn("moved", F.col("before") - F.col("volume") > SETTLED).drop("before")
        now = stage(moved.unionByName(now.where("not moved")), "scatter")
        if not now.where("moved").limit(1).count():
            break
    best = now.groupBy(*keys).agg(F.min(F.struct("volume", "start", *[f"m{i}" for i in range(DIM)], *[f"w{i}_{j}" for i in range(DIM) for j in range(i + 1)])).alias("e"))
    return stage(best.select(*keys, "e.*").drop("volume", "start"), "estimates")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Judge every document of the table.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance (squared, to the group's estimate), print (hash of the text). Groups with
    fewer than LEAST documents are judged by their language's estimate, and if that has fewer,
    by that of all documents; an empty table gives an empty result. Null and empty texts have no
    words and fail the base rule; null languages and sources are groups of their own; repeated
    rows and null keys are judged like any; other columns aren't read.

    The texts are read once. What is written to the shared folder has a row of numbers for
    each document; a group of any size is estimated by partial aggregates.
    """
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    keep = ["doc_id", "lang", "source", "print"]
    measured = statistics(given.withColumn("print", F.xxhash64(F.coalesce("text", F.lit("")))), keep)
    facts = stage(measured.select("*", *[column.alias(f"x{i}") for i, column in enumerate(vector().values())]), "statistics")
    # read back from files, a row's number and so its salt are the same whenever a task is run again
    facts = facts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    sizes = facts.groupBy("lang", "source").agg(F.count("*").alias("n"))
    tongues = sizes.groupBy("lang").agg(F.sum("n").alias("in_lang"))
    pools = sizes.join(tongues, "lang").select(
        "lang", "source",
        F.when(F.col("in_lang") >= LEAST, F.col("lang")).otherwise("*").alias("pool_lang"),
        F.when(F.col("n") >= LEAST, F.col("source")).otherwise("*").alias("pool_source"),
        (F.col("n") >= LEAST).alias("own"),
    )
    pools = stage(pools, "pools")
    numbers = [*[f"x{i}" for i in range(DIM)], "salt"]
    small = pools.where("not own").limit(1).count() > 0
    few = 3 * (2 * pools.count() + 1) <= MOST_GROUPS  # three starts each, with the languages' and the whole table's
    levels = with_groups(facts, pools, ["lang", "source"], few).where("own").select("pool_lang", "pool_source", *numbers)
    if small:  # estimates over a whole language, and over everything, for the small groups
        tongues = pools.where("not own").select("lang", "pool_lang").distinct()
        levels = levels.union(with_groups(facts, tongues, ["lang"], few).where("pool_lang <> '*'").select("pool_lang", F.lit("*").alias("pool_source"), *numbers))
        levels = levels.union(facts.select(F.lit("*").alias("pool_lang"), F.lit("*").alias("pool_source"), *numbers))
    estimates = estimate(levels, ["pool_lang", "pool_source"], few)
    scored = with_groups(with_groups(facts, pools, ["lang", "source"], few), estimates, ["pool_lang", "pool_source"], few, "left").withColumn("distance", _distance())
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"), "distance", "print",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of the table that ``judge`` keeps, with all their columns, whatever these are called.

    Null and empty texts go, having no words; rows equal in id and text are kept or go together; an
    empty table stays empty.
    """
    return with_marks(docs, judge(docs).where("kept"))
