"""First kept wins: which items of an ordered list stay when an item goes as soon as an earlier one that stays matches it.

The rule is sequential, but only along matches. Matches are cut into connected components, and a component is settled by one
task in the order of its items; many small components share a task. A component of more than `TASK_EDGES` matches is cut
along the order into slices. A slice settles all items whose earlier matches are settled, so the first slice is always done;
what is settled is taken out and the rest goes through another round. The number of rounds does not depend on how long
chains of matches are, only on how often a component exceeds a task.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .components import components

TASK_EDGES = 200_000
SLICES = 256


def settle(items: list[int], earlier: list[int], unknown: set[int]) -> dict[int, bool]:
    """Fates of ``items`` (True: stays), in the order of the list, each row with one ``earlier`` match of its item.

    An earlier item that is not listed itself stays, unless it is ``unknown``. Items that wait for one get no fate.
    """
    fates: dict[int, bool | None] = {}
    at = 0
    while at < len(items):
        item, stays = items[at], True
        while at < len(items) and items[at] == item:
            other = fates.get(earlier[at], None if earlier[at] in unknown else True)
            if other:
                stays = False
            elif other is None and stays:
                stays = None
            at += 1
        fates[item] = stays
    return {item: stays for item, stays in fates.items() if stays is not None}


def _binned(edges: DataFrame, task_edges: int) -> DataFrame:
    """Adds the bin of an edge: several whole components, or a slice along the order of one that exceeds a task."""
    labels = components(edges, "item", "earlier").withColumnRenamed("node", "item")
    edges = checkpoint(edges.join(labels, "item"))
    sizes = checkpoint(edges.groupBy("component").agg(F.count("*").alias("n")))
    bins = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // task_edges))
    large = sizes.where(F.col("n") > task_edges).select("component", F.least(F.lit(SLICES), F.ceil(F.col("n") / task_edges)).alias("slices"))
    shares = [k / SLICES for k in range(1, SLICES)]
    bounds = edges.join(large, "component").groupBy("component", "slices")
    bounds = bounds.agg(F.percentile_approx("place", shares).alias("bounds"))
    whole = F.struct(F.lit(-1).cast("bigint").alias("of"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("part"))
    part = F.floor(F.size(F.filter("bounds", lambda b: b < F.col("place"))) * F.col("slices") / SLICES)
    own = F.when(F.col("bounds").isNull(), whole).otherwise(F.struct(F.col("component").alias("of"), part.alias("part")))
    return edges.join(bounds, "component", "left").select("item", "place", "earlier", own.alias("bin"))


def _settle_bin(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["place", "item"])
    inside = set(frame["item"])
    unknown = set(frame.loc[frame["open"].notna(), "earlier"]) - inside  # items of other slices
    fates = settle(frame["item"].tolist(), frame["earlier"].tolist(), unknown)
    return pd.DataFrame({"item": pd.Series(fates.keys(), dtype="int64"), "stays": pd.Series(fates.values(), dtype="bool")})


def gone(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """The items that go (column item). ``edges``: item, place (its position), earlier (an item before it); distinct rows.

    Items without an edge, and those that are only ever the earlier one, stay. Items are bigint.
    """
    edges = checkpoint(_binned(edges, task_edges))
    parts = []
    while True:
        listed = edges.select(F.col("item").alias("earlier"), F.lit(True).alias("open")).distinct()
        known = edges.join(listed, "earlier", "left")
        fates = checkpoint(known.groupBy("bin").applyInPandas(_settle_bin, "item bigint, stays boolean"))
        parts.append(fates.where(~F.col("stays")).select("item"))
        # an item with an earlier one that stays goes; one that went has no say any more
        rest = edges.join(fates.select("item"), "item", "left_anti")
        rest = checkpoint(rest.join(fates.withColumnRenamed("item", "earlier"), "earlier", "left"))
        caught = checkpoint(rest.where("stays").select("item").distinct())
        parts.append(caught)
        edges = rest.where("stays is null").drop("stays").join(caught, "item", "left_anti")
        edges = checkpoint(edges.join(caught.withColumnRenamed("item", "earlier"), "earlier", "left_anti"))
        if edges.isEmpty():
            return reduce(DataFrame.unionByName, parts)
