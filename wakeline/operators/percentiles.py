"""Exact order statistics by radix selection.

A double is an integer of 64 bits in the same order. Its leading bits are counted first, one
row for each group and value of them; the running count says which of them hold the wanted
ranks. Only rows that begin like that are counted by the next bits, until all bits are known.
Every round is a partial count of few rows a group, whatever the values: nothing is sorted,
sampled or collected, and outliers and equal values cost nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wakeline.operators.segments import scan

#: Bits that are left to the next rounds: rounds of 22, 21 and 21 bits.
SHIFTS = (42, 21, 0)


def ordered_bits(value: Column) -> Column:
    """A double as a long of the same order; -0.0 is 0.0 and NaN comes last."""
    double = value.cast("double") + F.lit(0.0)
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), double).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    points: Mapping[str, float],
) -> DataFrame:
    """Linear-interpolated percentiles per group; ``points`` maps names to 0..1.

    Groups without a value are absent from the result.
    """
    if not points or any(not 0.0 <= p <= 1.0 for p in points.values()):
        raise ValueError("percentiles must lie in 0..1")
    names = [f"_k{i}" for i in range(len(keys))]
    known = df.where(F.col(value).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_x")
    )
    known = known.withColumn("_u", ordered_bits(F.col("_x")))

    def ranks(total: Column) -> Column:
        """The two ranks that each point lies between."""
        at = [F.lit(p) * (total - 1) for p in points.values()]
        both = [(2 * i + side, turn(a)) for i, a in enumerate(at) for side, turn in enumerate((F.floor, F.ceil))]
        return F.array(*[F.struct(F.lit(i).alias("at"), r.cast("bigint").alias("rank")) for i, r in both])

    begins = known.groupBy(*names, F.shiftright("_u", SHIFTS[0]).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    counted = begins.withColumns(
        {"_upto": F.sum("_n").over(scan(names, "_p")), "_total": F.sum("_n").over(W.partitionBy(*names))}
    )
    here = F.filter(ranks(F.col("_total")), lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_n")))
    wanted = counted.select(*names, "_p", "_total", (F.col("_upto") - F.col("_n")).alias("_below"), F.explode(here).alias("_r")).select(
        *names, F.col("_r.at").alias("_at"), (F.col("_r.rank") - F.col("_below")).alias("_rank"), "_p", "_total"
    )
    for before, shift in zip(SHIFTS, SHIFTS[1:]):
        targets = wanted.withColumnsRenamed({n: f"{n}w" for n in names})
        same = F.shiftright("_u", before) == F.col("_p")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"{n}w"))
        group = [*names, "_at"]
        cells = known.join(targets, same).groupBy(*group, F.shiftright("_u", shift).alias("_q")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_rank").alias("_rank"),
            F.max("_total").alias("_total"),
            F.min("_x").alias("_x"),
        )
        cells = cells.withColumn("_upto", F.sum("_n").over(scan(group, "_q")))
        holds = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))
        rank = F.col("_rank") - F.col("_upto") + F.col("_n")
        wanted = cells.where(holds).select(*group, rank.alias("_rank"), F.col("_q").alias("_p"), "_total", "_x")
        if shift:
            wanted = wanted.drop("_x")
    found = wanted.groupBy(*names).agg(
        F.max("_total").alias("_total"),
        *[F.max(F.when(F.col("_at") == i, F.col("_x"))).alias(f"_v{i}") for i in range(2 * len(points))],
    )
    out = []
    for i, (name, p) in enumerate(points.items()):
        position = F.lit(p) * (F.col("_total") - 1)
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    result = found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *out)
    return result.filter(F.col(next(iter(points))).isNotNull())


def threshold_at_percentile(
    df: DataFrame, value: str, percentile: float = 99.0, strict: bool = True
) -> DataFrame:
    """One row with the percentile of a whole column; no values is an error."""
    known = df.filter(F.col(value).isNotNull())
    found = exact_percentiles(known, [], value, {"threshold": percentile / 100.0})
    filled = found.agg(F.max("threshold").alias("threshold"))
    if not strict:
        return filled
    empty = F.raise_error(F.lit("cannot derive a threshold from no values")).cast("double")
    return filled.select(F.coalesce("threshold", empty).alias("threshold"))
