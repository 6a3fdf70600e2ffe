"""Connected components of a link table, by contraction."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links(u, v)``; equal labels, one component.

    Each round hangs every node on the neighbour (or itself) that comes first in an order
    drawn anew (of the ids with random bits flipped), and goes on with the links between what
    they hang on. About a constant share of the nodes goes in a round, whatever the shape, so
    rounds grow with the logarithm of the nodes. What a round finds is written, so a lost
    executor costs one round at most.
    """
    links = staged(links.select("u", "v").where("u <> v").distinct())
    labels, turn = None, 0
    while not links.isEmpty():
        ends = links.union(links.select("v", "u"))
        flip = F.lit(int.from_bytes(hashlib.sha256(b"%d" % turn).digest()[:8], "little", signed=True))
        first = F.least(F.min(F.col("v").bitwiseXOR(flip)), F.col("u").bitwiseXOR(flip))
        up = staged(ends.groupBy("u").agg(first.bitwiseXOR(flip).alias("p")))
        step = up.select(F.col("u").alias("_u"), "p")
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            moved = labels.join(step, F.col("label") == F.col("_u"), "left")
            labels = staged(moved.select("node", F.coalesce("p", "label").alias("label")))
        left = links.join(step, F.col("u") == F.col("_u")).select(F.col("p").alias("u"), "v")
        left = left.join(step, F.col("v") == F.col("_u")).select("u", F.col("p").alias("v"))
        links = staged(left.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        turn += 1
    if labels is None:
        labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels
