"""Mixing sources to target weights: iterative proportional fitting.

Token counts per cell (one value of each dimension: source, language, topic) are raked: every sweep
scales the cells' weights to each dimension's target share in turn, until all marginals agree. The
ratio of a cell's raked weight to its tokens, scaled to the asked number of tokens and held to at most
one, is the probability by which each of its documents is sampled, against a number derived from the
document's id and a seed.

Cells are aggregated before anything is shuffled by value; joining them back broadcasts them only up
to a checked number of cells and salts beyond it.

Raking looks at its marginals every third sweep and ends when none is off by more than a tolerance. Targets made here,
of each dimension apart from the others, can contradict the cells there are (two sources of one language each have one
share, not two). Where raking does not come within ``ACCEPTED`` of them it goes to the nearest shares that cells can have,
by averaged Kullback-Leibler projections: every sweep multiplies a cell by the geometric mean of its dimensions' corrections,
which settles where the divergence of the marginals from their targets, added up, is least. How far each marginal ends
from its targets is returned. Targets that a caller passes raise an error instead.

Edge cases: a null dimension value counts as ''; a null text has no tokens and goes by its cell's
probability; rows with equal (or null) doc_id share their fate if they are of one cell; cells without
tokens have probability one; an empty table gives no rows; extra columns are kept under their own names,
but one named ``mix`` gives way to the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

SWEEPS, SWEEPS_AT_ONCE, TOLERANCE, ACCEPTED = 120, 3, 1e-6, 1e-3
#: Sweeps of averaged projections, as many times as those of raking: they take smaller steps.
AVERAGED = 20
BROADCAST_CELLS = 100_000
#: Up to so many cells (counted first) are raked on the driver; more are raked by joins, by the same rule.
DRIVER_CELLS = 50_000
SALTS = 64
#: Candidates per pass, and passes, of the search for the scale.
GRID, PASSES = 64, 8


def topic(bits: int = 3) -> Column:
    """One of 2 ^ bits topics by what a text's words say: bit k tells on which side of a fixed random plane its words of five or more characters lie.

    Each word's hash gives it a side of every plane; texts of like words come to like sums.
    """
    found = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), " "), lambda w: F.length(w) >= 5)
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    one = lambda h, k: F.shiftright(h, k).bitwiseAND(F.lit(1).cast("long"))
    fields = [f"p{k}" for k in range(bits)]
    none = F.struct(*(F.lit(0).cast("long").alias(f) for f in [*fields, "n"]))

    def add(a: Column, h: Column) -> Column:
        return F.struct(*((a[f] + one(h, k)).alias(f) for k, f in enumerate(fields)), (a["n"] + 1).alias("n"))

    # All that follows from the sums is said in the last step, so the words are gone through once.
    return F.aggregate(hashes, none, add, lambda a: F.concat(*(F.when(2 * a[f] > a["n"], "1").otherwise("0") for f in fields)))


def words() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")), F.lit(0)).cast("long")


def smoothed_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares in proportion to a power of a dimension's tokens: below one flattens large sources."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("share"))
    total = sums.agg(F.sum("share").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("value", (F.col("share") / F.col("total")).alias("share"))  # total: one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, nearest: bool = False) -> tuple[DataFrame, float]:
    """cells (the dimensions, tokens) with their raked weight, which sums to one; the largest deviation of a marginal.

    targets: for each dimension a table (value, share) of shares that sum to one. A value without a target gets weight 0.
    nearest: go to the nearest shares that the cells can have where the targets contradict them.
    """
    way = rake_on_driver if cells.count() <= DRIVER_CELLS else rake_by_joins
    return way(cells, targets, sweeps, tolerance, nearest)


def rake_on_driver(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float, nearest: bool = False) -> tuple[DataFrame, float]:
    rows = cells.collect()
    wanted = {d: {r["value"]: r["share"] for r in t.collect()} for d, t in targets.items()}  # at most as many values as cells, else no cell has them
    weight, gaps = raked_weights(rows, wanted, sweeps, tolerance, nearest)
    return _with_weights(cells, rows, weight), max(gaps.values(), default=0.0)


def raked_weights(rows: list, targets: dict[str, dict], sweeps: int = SWEEPS, tolerance: float = TOLERANCE, nearest: bool = False) -> tuple[np.ndarray, dict[str, float]]:
    """The weights of so many cells, and the largest deviation of each dimension's marginal."""
    tokens = np.array([r["tokens"] for r in rows], float)
    first, gaps = tokens / max(tokens.sum(), 1.0), dict.fromkeys(targets, 0.0)
    places, shares = {}, {}
    for d, target in targets.items():
        at = {v: i for i, v in enumerate(dict.fromkeys(r[d] for r in rows))}
        places[d], shares[d] = np.array([at[r[d]] for r in rows], int), np.array([target.get(v, 0.0) for v in at])
    if not rows:
        return first, gaps

    def margin(d: str, weight: np.ndarray) -> np.ndarray:
        return np.bincount(places[d], weight, len(shares[d]))

    def correction(d: str, weight: np.ndarray) -> np.ndarray:
        now = margin(d, weight)
        return np.divide(shares[d], now, out=np.zeros_like(now), where=now > 0)[places[d]]

    def off(weight: np.ndarray) -> dict[str, float]:
        return {d: float(np.abs(margin(d, weight) - shares[d]).max()) for d in targets}

    weight = first
    for _ in range(0, sweeps, SWEEPS_AT_ONCE):
        for d in [*targets] * SWEEPS_AT_ONCE:
            weight = weight * correction(d, weight)
        gaps = off(weight)
        if max(gaps.values()) <= tolerance:
            break
    if nearest and max(gaps.values()) > ACCEPTED:
        weight = first
        for _ in range(sweeps * AVERAGED):
            last = weight
            for part in [correction(d, last) ** (1 / len(targets)) for d in targets]:
                weight = weight * part
            weight = weight / max(weight.sum(), 1e-300)
            if np.abs(weight - last).max() <= tolerance / 100:
                break
        gaps = off(weight)
    return weight, gaps


def _with_weights(cells: DataFrame, rows: list, weight: np.ndarray) -> DataFrame:
    names = cells.columns
    data = [(*(r[c] for c in names), float(w)) for r, w in zip(rows, weight, strict=True)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields), "weight double"])
    return cells.sparkSession.createDataFrame(data, schema)


def rake_by_joins(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float, nearest: bool = False) -> tuple[DataFrame, float]:
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    first = cells.withColumn("weight", F.col("tokens") / F.lit(float(max(total, 1))))
    state, deviation = first, float("inf")

    def corrected(of: DataFrame, dimension: str, name: str) -> DataFrame:
        margin = of.groupBy(F.col(dimension).alias("value")).agg(F.sum("weight").alias("now"))
        scale = margin.join(targets[dimension], "value", "left").select("value", F.coalesce(F.try_divide("share", "now"), F.lit(0.0)).alias(name))
        return state.join(scale, F.col(dimension) == F.col("value"), "left").drop("value")

    for done in range(0, sweeps, SWEEPS_AT_ONCE):
        for _ in range(SWEEPS_AT_ONCE):
            for dimension in targets:
                state = corrected(state, dimension, "scale").withColumn("weight", F.col("weight") * F.col("scale")).drop("scale")
        state = materialize(state, f"raking-{done}")
        was, deviation = deviation, max(gaps_of(state, targets).values(), default=0.0)
        if deviation <= tolerance or abs(deviation - was) <= tolerance / 100:  # there, or as near as it comes
            break
    if nearest and deviation > ACCEPTED:
        state = first
        for done in range(0, sweeps, SWEEPS_AT_ONCE):
            for _ in range(SWEEPS_AT_ONCE):
                before = state
                for i, dimension in enumerate(targets):
                    state = corrected(before, dimension, f"scale{i}")
                scales = [F.pow(f"scale{i}", F.lit(1 / len(targets))) for i in range(len(targets))]
                state = state.withColumn("weight", reduce(lambda a, b: a * b, scales, F.col("weight"))).drop(*(f"scale{i}" for i in range(len(targets))))
            state = materialize(state, f"averaging-{done}")
            state = state.withColumn("weight", F.col("weight") / F.lit(state.agg(F.sum("weight")).first()[0] or 1.0))
            was, deviation = deviation, max(gaps_of(state, targets).values(), default=0.0)
            if abs(deviation - was) <= tolerance / 100:
                break
    return state, deviation


def gaps_of(raked: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """The largest deviation of each dimension's marginal from its targets."""
    found = [
        raked.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("now")).join(t, "value").agg(F.lit(d).alias("dimension"), F.max(F.abs(F.col("now") - F.col("share"))).alias("gap"))
        for d, t in targets.items()
    ]
    return {r["dimension"]: r["gap"] or 0.0 for r in reduce(DataFrame.unionByName, found).collect()}  # a row per dimension


def scale_for(cells: DataFrame, tokens: float) -> float:
    """The scale of the weight/token ratios at which the sampled tokens are expected to be so many."""
    ratio = F.try_divide("weight", "tokens")
    low, high = 0.0, cells.agg(F.max(F.try_divide(F.lit(1.0), ratio))).first()[0]
    if high is None:
        return 0.0
    for _ in range(PASSES):
        steps = [low + (high - low) * i / GRID for i in range(1, GRID + 1)]
        sums = cells.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * s)).alias(f"s{i}") for i, s in enumerate(steps))).first()
        at = next((i for i in range(GRID) if (sums[i] or 0) >= tokens), None)
        if at is None:
            return high
        low, high = (steps[at - 1] if at else low), steps[at]
    return high


def uniform(seed: int) -> Column:
    """A number in [0, 1) from the seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def scale_of(tokens: np.ndarray, weight: np.ndarray, wanted: float) -> float:
    """The same scale for cells that are on the driver, by bisection."""
    ratio = weight[tokens > 0] / tokens[tokens > 0]
    if not len(ratio) or not (ratio > 0).any():
        return 0.0
    low, high = 0.0, float(1 / ratio[ratio > 0].min())
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if (tokens[tokens > 0] * np.minimum(1.0, ratio * middle)).sum() >= wanted else (middle, high)
    return high


def sample_probabilities(docs: DataFrame, dimensions: dict[str, Column], powers: dict[str, float], fraction: float, seed: int = 7, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """docs with the struct column ``mix``: each dimension's value, tokens, probability, whether it is sampled, and ``<dimension>_gap``.

    powers: for each dimension the power of its smoothed targets. targets: shares of a caller's own instead, for all of
    the dimensions; they raise an error where the cells can't have them. fraction: expected share of all tokens. A gap is
    the largest deviation of a dimension's raked shares from its targets.
    """
    names = list(dimensions)
    cell, found, salt = (_free(docs, n) for n in ("cell", "probability", "salt"))
    mixed = docs.withColumn("mix", F.struct(*(F.coalesce(c.cast("string"), F.lit("")).alias(d) for d, c in dimensions.items()), words().alias("tokens")))
    cells = mixed.groupBy(*(F.col(f"mix.{d}").alias(d) for d in names)).agg(F.sum("mix.tokens").alias("tokens"))
    cells = materialize(cells, "mixing-cells")
    count = cells.count()
    if count <= DRIVER_CELLS:
        rows = cells.collect()
        wanted = targets or {d: _smoothed(rows, d, powers[d]) for d in names}
        weight, gaps = raked_weights(rows, wanted, nearest=targets is None)
        raked, tokens = _with_weights(cells, rows, weight), np.array([r["tokens"] for r in rows], float)
        scale = scale_of(tokens, weight, fraction * tokens.sum())
    else:
        made = {d: cells.sparkSession.createDataFrame([*targets[d].items()], "value string, share double") if targets else materialize(smoothed_targets(cells, d, powers[d]), f"mixing-{d}") for d in names}
        raked, _ = rake_by_joins(cells, made, SWEEPS, TOLERANCE, targets is None)
        gaps = gaps_of(raked, made)
        scale = scale_for(raked, fraction * (cells.agg(F.sum("tokens")).first()[0] or 0))
    if targets and max(gaps.values()) > ACCEPTED:
        raise ValueError(f"raking has not settled: the cells can't have the targets, marginals are off by {gaps}")
    chance = F.coalesce(F.least(F.lit(1.0), F.try_divide("weight", "tokens") * scale), F.lit(1.0))
    calibrated = raked.select(F.struct(*names).alias(cell), chance.alias(found))
    key = F.struct(*(F.col(f"mix.{d}").alias(d) for d in names))
    if count <= BROADCAST_CELLS:
        joined = mixed.join(F.broadcast(calibrated), key == F.col(cell))
    else:
        salted = calibrated.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = mixed.join(salted, (key == F.col(cell)) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int") == F.col(salt))).drop(salt)
    off = [F.lit(float(gaps[d])).alias(f"{d}_gap") for d in names]
    return joined.withColumn("mix", F.struct(F.col("mix.*"), F.col(found).alias("probability"), (uniform(seed) < F.col(found)).alias("sampled"), *off)).drop(cell, found)


def _smoothed(rows: list, dimension: str, power: float) -> dict[str, float]:
    """smoothed_targets() of cells that are on the driver."""
    sums: dict[str, float] = {}
    for r in rows:
        sums[r[dimension]] = sums.get(r[dimension], 0.0) + r["tokens"]
    whole = sum(v**power for v in sums.values() if v) or 1.0
    return {k: v**power / whole if v else 0.0 for k, v in sums.items()}


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns} | {"mix"}
    name = f"mix_{name}"
    while name in taken:
        name += "_"
    return name
