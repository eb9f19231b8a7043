"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.store import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link, and none of its own larger ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node
    of its component.

    Each round replaces links by links to the smallest neighbour (large star:
    of larger neighbours; small star: of smaller ones), which keeps components
    and ends in one star per component after a few rounds. Minima are combined
    before the shuffle; the join back on a node with very many links is one that
    AQE can split. Every round starts from a written table; links that are stars
    already need none. Nodes without a link, null ends and loops do not appear; repeated and reversed links count once."""
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = stored(small)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def prefix_groups(tokens: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, size, place): groups in which every two sets of a Jaccard similarity of ``threshold``
    or more meet. ``tokens`` has a row (node, size, token) for each element of each set.

    With the elements of all sets in one order, two such sets share one of their first
    elements: if x and y overlap in k elements, the first they share stands at place
    |x| - k of x at the latest. The order is by rarity, so what many sets have in common
    (a template, a passage, a boilerplate line) stands last and brings nobody together
    who does not share nearly all. As k is at least ``threshold`` of the larger size, a set takes
    part with as many of its first elements as leave that; whether a pair's sizes and places leave
    enough for both is asked when they meet (``linked``). Elements of one set only have no partner
    and are counted, but not exchanged any further."""
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    met = tokens.join(shared, "token")
    own = Window.partitionBy("node")
    size = F.col("size").cast("double")
    # elements without a partner stand first
    place = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("sets", "token")) - 1
    met = met.withColumn("place", place).filter(F.col("place") <= size - F.ceil(threshold * size - 1e-6))
    return met.select(F.col("token").alias("bucket"), "node", "size", "place")


def linked(members: DataFrame, verify, pairs: DataFrame, roots: DataFrame, threshold: float, heads: int = 3) -> DataFrame:
    """(node, root) of the components of ``roots`` joined by all pairs of a bucket of ``members``
    (``prefix_groups``) that ``verify`` keeps. ``pairs`` were verified before and gave ``roots``.

    In the first rounds one member of a bucket, another one each time, is compared
    with all the others of other components and leaves the bucket; so a large group of near
    copies becomes one component by a link per member. In the last round all pairs
    that still lie in different components are compared. Of every pair only that
    token counts which leaves room for enough overlap in both sets: the first token
    that two similar sets share does, so no pair is lost; sets that share a
    template drop out here, before any text is read."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    members = members.filter("size > 0")
    for step in range(heads + 1):
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        placed = stored(placed.join(split.select("bucket"), "bucket", "left_semi"))
        if placed.isEmpty():
            return roots
        other = placed
        if step < heads:
            other = stored(placed.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n"))
        other = other.select("bucket", F.col("node").alias("node2"), F.col("root").alias("root2"),
                             F.col("size").alias("size2"), F.col("place").alias("place2"))
        room = F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2"))
        fits = room >= F.ceil(threshold / (1 + threshold) * (F.col("size") + F.col("size2")) - 1e-6)
        met = placed.join(other, (placed["bucket"] == other["bucket"]) & (F.col("root") != F.col("root2")) & fits
                          & ((F.col("node") > F.col("node2")) if step == heads else F.lit(True)))
        more = stored(met.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()
                      .join(pairs, ["u", "v"], "left_anti"))
        if not more.isEmpty():
            new = stored(verify(more))
            if not new.isEmpty():
                roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new))
        if step < heads:
            pairs = pairs.select("u", "v").unionByName(more)
            members = placed.drop("root").join(other.select("bucket", F.col("node2").alias("node")), ["bucket", "node"], "left_anti")
    return roots
