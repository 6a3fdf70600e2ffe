"""Mixing sources to target weights by Poisson replication.

A source's rate is the repetition that gives it its target share of the mixture. Each row
draws a uniform number from a hash of seed and id, and repeats as often as the inverse of the
Poisson distribution with its source's rate says, so a row's copies depend on nothing but the
row, the rates and the seed. Copies then go into one global order by hash. DataFrame
functions only.

Defined results: null sources are one source; rows without id draw as the id ``null``; rows
that share an id and a source repeat alike; empty and null texts weigh nothing and repeat at
their source's rate (1 for a source without any text); an empty table gives an empty result;
other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.staging import staged, unused

SEED = 17
POWER = 0.5


def uniform(*parts: str | Column) -> Column:
    """A number in [0, 1) of 52 bits from a hash of the parts."""
    text = F.concat_ws(":", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def repetition_rates(
    docs: DataFrame,
    by: str = "source",
    text: str = "text",
    weights: Mapping[str, float] | None = None,
    power: float = POWER,
    epochs: float = 1.0,
) -> DataFrame:
    """``by, rate``: mean repetitions that give each source its weight.

    ``weights`` names target weights (sources without one get 0); without it a source weighs
    its size to the power ``power``. The mixture is ``epochs`` times as large as the corpus.
    """
    sizes = docs.groupBy(by).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(power)))
    else:
        table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
        weight = F.lit(0.0) if table is None else F.coalesce(F.try_element_at(table, F.col(by)), F.lit(0.0))
        weight = F.when(F.col("size") > 0, weight).otherwise(0.0)
    weighed = staged(sizes.withColumn("weight", weight))
    total = weighed.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))
    rate = F.col("weight") / F.col("weights") * F.col("all") * F.lit(float(epochs)) / F.col("size")
    return weighed.crossJoin(total).select(
        by, F.when((F.col("size") > 0) & (F.col("weights") > 0), F.round(rate, 9)).otherwise(1.0).alias("rate")
    )


def cumulative(rate: Column) -> Column:
    """Poisson distribution function at 0, 1, ... as far as doubles tell it from 1.

    Terms are carried as logarithms, so large rates do not underflow.
    """
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 25).cast("int"))
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate / k)
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(steps, first, step, lambda s: s["all"])).otherwise(F.array(F.lit(2.0)))


def replicate(
    docs: DataFrame, rates: DataFrame, by: str = "source", id: str = "doc_id", seed: int = SEED
) -> DataFrame:
    """``docs`` with ``copy`` (from 0) and ``shuffle_key``, in the order of the key; where
    ``docs`` has columns of those names they stay, and the new ones begin with ``_``.

    The distribution is tabulated once per source. That table is read from files, so the
    planner knows its size: it is broadcast while small, and else the join splits hot sources.
    Keys are uniform, so the order is cut at fixed points and nothing is sampled for it.
    """
    taken = {c.lower() for c in docs.columns}
    copy, shuffle_key = (unused(docs, c) if c in taken else c for c in ("copy", "shuffle_key"))
    group, steps, n = (unused(docs, stem) for stem in ("mixed_source", "mixed_steps", "mixed_times"))
    table = staged(rates.select(F.col(by).alias(group), cumulative(F.col("rate")).alias(steps)))
    draw = uniform(F.lit(seed), id, by)
    rows = docs.join(table, F.col(by).eqNullSafe(F.col(group)))
    rows = rows.withColumn(n, F.size(F.filter(steps, lambda c: c <= draw))).where(F.col(n) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col(id).cast("string"), F.lit("null")), F.col(copy).cast("string")))
    out = rows.withColumn(shuffle_key, key).drop(group, steps, n)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring(shuffle_key, 1, 7), 16, 10).cast("bigint") * parts / 16**7).cast("int")
    return out.repartitionById(parts, place).sortWithinPartitions(shuffle_key)


def mix(docs: DataFrame, by: str = "source", text: str = "text", id: str = "doc_id", **targets) -> DataFrame:
    """Replicated and globally shuffled ``docs``."""
    return replicate(docs, repetition_rates(docs, by, text, **targets), by, id)
