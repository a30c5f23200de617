"""Statistics of paired deltas: description, sign tests, resampling, multiplicity.

Closed forms are Column expressions over one aggregation. Resampling and tail probabilities
run per group in numpy; a group is the vector of one contrast's unit deltas (tasks or
families), at most MAX_UNITS numbers. For more units there are `signflip_spread` and
`bootstrap_spread`, whose draws are a deterministic function of (draw, unit) and whose sums
are ordinary distributed aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seed, draws and level of the published analysis. Fixed values.
SEED, SIGN_FLIPS, BOOTSTRAPS, CONFIDENCE = 20260916, 200_000, 100_000, 0.99
#: Numbers drawn that are in memory at once: draws times units.
CELLS = 1 << 20
#: Units that one group may have; more go through the spread forms.
MAX_UNITS = 100_000


def describe(deltas: DataFrame, keys: Sequence[str], delta: str) -> DataFrame:
    """n, mean, median, sample SD, dz, and counts by sign; dz is null without spread.

    The median is exact: it holds the different values of a group, whose units resample() bounds too.
    """
    x = F.col(delta)
    out = deltas.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_samp(x).alias("sd"),
        F.count(F.when(x > 0, 1)).alias("positive"), F.count(F.when(x < 0, 1)).alias("negative"), F.count(F.when(x == 0, 1)).alias("zero"),
    )
    return out.withColumns({"cohens_dz": F.col("mean") / F.when(F.col("sd") > 0, F.col("sd")), "positive_fraction": F.col("positive") / F.col("n")})


def binomial_sum(n: Column, low: Column, high: Column) -> Column:
    """P(low <= X <= high) for X ~ Binomial(n, 1/2), by the recurrence of log coefficients."""
    n = n.cast("long")
    start = F.struct((-n * F.lit(math.log(2.0))).cast("double").alias("ln"), F.when(low <= 0, F.exp(-n * F.lit(math.log(2.0)))).otherwise(0.0).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        ln = acc["ln"] + F.log((n - k + 1) / k)
        return F.struct(ln.alias("ln"), (acc["sum"] + F.when((k >= low) & (k <= high), F.exp(ln)).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>")), start, step, lambda acc: acc["sum"])


def exact_sign_p(positive: Column, n: Column, two_sided: Column) -> Column:
    """Exact sign test with zeros kept in n; the two-sided form doubles the smaller tail up to 1."""
    fewer = F.least(positive, n - positive)
    return F.when(two_sided, F.least(F.lit(1.0), 2 * binomial_sum(n, F.lit(0), fewer))).otherwise(binomial_sum(n, positive, n))


def holm(rows: DataFrame, keys: Sequence[str], p: str, tie: str, name: str = "holm_adjusted_p") -> DataFrame:
    """Holm's step-down adjustment within `keys`; equal p-values keep the order of `tie`."""
    family = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ordered = family.orderBy(p, tie)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(ordered) + 1) * F.col(p))
    out = rows.withColumn("_scaled", scaled)
    return out.withColumn(name, F.max("_scaled").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_scaled")


def _chunks(draws: int, units: int) -> Iterator[int]:
    """How many draws to take at once; the generator gives the same numbers however they are cut."""
    rows = max(1, CELLS // max(1, units))
    for start in range(0, draws, rows):
        yield min(rows, draws - start)


def flip_test(x: np.ndarray, two_sided: bool, draws: int = SIGN_FLIPS, seed: int = SEED) -> tuple[int, float]:
    """Extreme draws, and (extreme + 1) / (draws + 1), of the sign-flip test on the mean.

    The generator is made anew for each vector: vectors of equal length share their signs.
    """
    rng, seen, extreme = np.random.default_rng(seed), abs(x.mean()) if two_sided else x.mean(), 0
    for rows in _chunks(draws, len(x)):
        up = rng.integers(0, 2, size=(rows, len(x)), dtype=np.int64)
        means = np.where(up == 1, x, -x).mean(axis=1)
        extreme += int(((np.abs(means) if two_sided else means) >= seen).sum())
    return extreme, (extreme + 1) / (draws + 1)


def percentile_ci(x: np.ndarray, draws: int = BOOTSTRAPS, confidence: float = CONFIDENCE, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the mean under resampling with replacement."""
    rng = np.random.default_rng(seed)
    means = np.concatenate([x[rng.integers(0, len(x), size=(rows, len(x)))].mean(axis=1) for rows in _chunks(draws, len(x))])
    half = (1.0 - confidence) / 2.0
    return float(np.quantile(means, half)), float(np.quantile(means, 1.0 - half))


def signed_rank_p(x: np.ndarray) -> float | None:
    """One-sided (greater) Wilcoxon signed-rank test, zeros dropped.

    Exact for at most 50 untied values, else the normal approximation with tie correction and
    without continuity correction.
    """
    x = x[x != 0]
    n = len(x)
    if not n:
        return None
    size = np.abs(x)
    order = np.argsort(size, kind="stable")
    values, first, many = np.unique(size[order], return_index=True, return_counts=True)
    rank = np.empty(n)
    rank[order] = np.repeat(first + (many + 1) / 2, many)
    w = rank[x > 0].sum()
    if n <= 50 and len(values) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(ways[int(w) :].sum() / 2.0**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - float((many**3 - many).sum()) / 48)
    return 0.5 * math.erfc((w - n * (n + 1) / 4) / spread / math.sqrt(2))


def student_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    if t < 0:
        return 1.0 - student_tail(-t, df)
    return 0.5 * _incomplete_beta(df / (df + t * t), df / 2, 0.5)


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    c, out = 1.0, d
    for m in range(1, 500):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + part * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + part / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def t_test_p(x: np.ndarray) -> float | None:
    """One-sample t-test against zero, greater."""
    if len(x) < 2 or x.std(ddof=1) == 0:
        return None
    return student_tail(float(x.mean() / (x.std(ddof=1) / math.sqrt(len(x)))), len(x) - 1)


RESAMPLED = "n_units long, extreme_resamples long, n_resamples long, signflip_p double, ci_low double, ci_high double, wilcoxon_p double, t_test_p double"


def resample(deltas: DataFrame, keys: Sequence[str], unit: Sequence[str], delta: str, two_sided: str | None = None, flips: int = SIGN_FLIPS, boots: int = BOOTSTRAPS, confidence: float = CONFIDENCE, seed: int = SEED) -> DataFrame:
    """Seeded tests and intervals of each group; column `two_sided` holds the alternative.

    Values are put in the order of `unit` inside the function, because draws are assigned by
    position and a shuffle has no order.
    """
    unit = list(unit)

    def group(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_UNITS:
            raise ValueError("too many units for one group; use the spread forms")
        x = frame.sort_values(unit)[delta].dropna().to_numpy(float)
        row = {k: frame[k].iloc[0] for k in keys}
        if not len(x):
            return pd.DataFrame([row | dict.fromkeys((c.split()[0] for c in RESAMPLED.split(", ")), None) | {"n_units": 0}])
        extreme, p = flip_test(x, bool(frame[two_sided].iloc[0]) if two_sided else False, flips, seed)
        low, high = percentile_ci(x, boots, confidence, seed)
        return pd.DataFrame([row | {"n_units": len(x), "extreme_resamples": extreme, "n_resamples": flips, "signflip_p": p, "ci_low": low, "ci_high": high, "wilcoxon_p": signed_rank_p(x), "t_test_p": t_test_p(x)}])

    fields = ", ".join(f"`{k}` {deltas.schema[k].dataType.simpleString()}" for k in keys)
    columns = list(dict.fromkeys([*keys, *unit, delta, *([two_sided] if two_sided else [])]))
    return deltas.select(*columns).groupBy(*keys).applyInPandas(group, f"{fields}, {RESAMPLED}")


def _mix(draw: Column, unit: Column, modulus: int) -> Column:
    """A fixed pseudo-random number below `modulus` for each (draw, unit)."""
    return F.pmod(draw * 7919 + unit * 104729 + F.pmod(draw * unit, F.lit(997)) * 31 + F.pmod(draw * draw + unit, F.lit(1009)) * 613, F.lit(modulus).cast("long"))


def numbered(deltas: DataFrame, keys: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Add `unit_no` from 0 within each group, and `n_units`.

    Units are dealt over 4096 blocks of a group by a hash and numbered by (hash, unit), so that no
    window holds a whole group.
    """
    salted = deltas.withColumn("_salt", F.substring(F.md5(F.concat_ws(":", *(F.col(u).cast("string") for u in unit))), 1, 3))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    blocks = blocks.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("n_units"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*unit)) - 1
    return salted.withColumn("_at", inner).join(blocks, [*keys, "_salt"]).withColumn("unit_no", (F.col("_base") + F.col("_at")).cast("long")).drop("_salt", "_base", "_at")


def signflip_spread(deltas: DataFrame, keys: Sequence[str], delta: str, draws: int) -> DataFrame:
    """Sign-flip test (greater) by distributed sums: each unit adds its signed delta to every draw.

    `deltas` comes from numbered(). Draws per group are a parameter, and partial sums are
    combined before the shuffle, so what moves is (groups x draws), whatever the units.
    """
    flipped = deltas.select(*keys, "unit_no", F.col(delta).alias("_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    up = (F.col("draw") == 0) | (_mix(F.col("draw"), F.col("unit_no"), 1024) < 512)  # draw 0 is the observed mean
    means = flipped.groupBy(*keys, "draw").agg(F.avg(F.when(up, F.col("_x")).otherwise(-F.col("_x"))).alias("mean"))
    return _against_observed(means, keys, draws)


def _against_observed(means: DataFrame, keys: Sequence[str], draws: int) -> DataFrame:
    """Extreme draws per group: at most `draws` + 1 rows each."""
    seen = F.max(F.when(F.col("draw") == 0, F.col("mean"))).over(Window.partitionBy(*keys))
    out = means.withColumn("observed_mean", seen).groupBy(*keys).agg(F.first("observed_mean").alias("observed_mean"), F.count(F.when((F.col("draw") > 0) & (F.col("mean") >= F.col("observed_mean") - 1e-9), 1)).alias("extreme_resamples"))
    return out.withColumns({"n_resamples": F.lit(draws).cast("long"), "p_plus1": (F.col("extreme_resamples") + 1) / (draws + 1)})


def bootstrap_spread(deltas: DataFrame, keys: Sequence[str], delta: str, draws: int, confidence: float = CONFIDENCE) -> DataFrame:
    """Percentile interval by distributed sums.

    In each draw the n slots of a group pick unit (mix mod n); a pick is a join of slot and unit
    numbers on an equal key, so no pair of units is formed.
    """
    picks = deltas.select(*keys, "n_units", F.col("unit_no").alias("_slot")).select(*keys, "n_units", "_slot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    picks = picks.withColumn("unit_no", F.pmod(_mix(F.col("draw"), F.col("_slot"), 1 << 20), F.col("n_units"))).groupBy(*keys, "draw", "unit_no").agg(F.count(F.lit(1)).alias("_times"))
    means = picks.join(deltas.select(*keys, "unit_no", F.col(delta).alias("_x"), "n_units"), [*keys, "unit_no"]).groupBy(*keys, "draw").agg((F.sum(F.col("_x") * F.col("_times")) / F.sum("_times")).alias("mean"))
    half = (1 - confidence) / 2
    return means.groupBy(*keys).agg(F.percentile("mean", half).alias("ci_low"), F.percentile("mean", 1 - half).alias("ci_high"), F.count(F.lit(1)).alias("n_resamples"))
