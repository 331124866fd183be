"""Lineage walks and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollate.session import cut


def children(df: DataFrame, parent: int, limit: int = 1000, key: str = "doc_id", up: str = "derived_from") -> DataFrame:
    """What is derived from a record directly, oldest first; limit is clamped to 1..1000."""
    return df.filter(F.col(up) == parent).orderBy("created_at", key).limit(min(max(limit, 1), 1000))


def ancestors(df: DataFrame, key: str = "doc_id", up: str = "derived_from") -> DataFrame:
    """key, root, depth, broken, cycle of every record's way to its root, by pointer jumping: a number of joins that is the logarithm of the depth.

    broken: the way ends at a parent that isn't there; cycle: the way never ends, root and depth are then null.
    """
    nodes = df.select(F.col(key).alias("key"), F.col(up).alias("parent")).dropDuplicates(["key"])
    known = nodes.select(F.col("key").alias("parent"), F.lit(True).alias("known"))
    start = nodes.join(known, "parent", "left")
    state = start.select(
        "key",
        F.when(F.col("known"), F.col("parent")).otherwise(F.col("key")).alias("top"),
        F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"),
        (F.col("parent").isNotNull() & F.col("known").isNull()).alias("broken"),
        F.coalesce(F.col("known"), F.lit(False)).alias("open"),
    )
    total = None
    while True:
        state = cut(state)
        if total is None:
            total = state.count()
        most = state.filter("open").agg(F.max("depth")).first()[0]
        if most is None or most > total:
            break
        above = state.select(F.col("key").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"), F.col("broken").alias("broken2"), F.col("open").alias("open2"))
        moved = state.filter("open").join(above, "top")
        state = (
            moved.select("key", F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("broken2").alias("broken"), F.col("open2").alias("open"))
            .unionByName(state.filter("NOT open"))
        )
    return state.select("key", F.when(~F.col("open"), F.col("top")).alias("root"), F.when(~F.col("open"), F.col("depth")).alias("depth"), "broken", F.col("open").alias("cycle"))


def opaque(df: DataFrame, **names: str) -> DataFrame:
    """The named columns of df, new name = old one, as values whose expressions the optimizer can't see.

    A checkpoint keeps the constraints of its plan. If the parent is computed from the key, each join of parent and key puts that expression into
    itself once more, and a walk of fifteen levels fills the driver.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(old).alias(new) for new, old in names.items()]))))


def descendants(df: DataFrame, root: int, key: str = "doc_id", up: str = "derived_from") -> DataFrame:
    """key, depth of everything derived from root, level by level; a node is visited once, so cycles end."""
    edges = opaque(df, key=key, parent=up)
    found = cut(edges.filter(F.col("parent") == root).select("key").distinct().withColumn("depth", F.lit(1)))
    frontier, depth = found, 1
    while not frontier.isEmpty():
        depth += 1
        below = edges.join(frontier.select(F.col("key").alias("parent")), "parent").select("key").distinct()
        frontier = cut(below.join(found, "key", "left_anti").filter(F.col("key") != root).withColumn("depth", F.lit(depth)))
        found = cut(found.unionByName(frontier))
    return found


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node of each connected component of the pairs.

    Each round links every node to the least neighbour of its label and then jumps along the labels, so the rounds grow with the
    logarithm of the longest path. Labels live in the shared checkpoint folder; nothing is collected but whether any changed.
    """
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    edges = cut(both)
    labels = cut(edges.select(F.col("x").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("least"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = cut(hooked.join(jump, "next").select("node", "label", "further"))
        if moved.filter("label <> further").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = moved.select("node", F.col("further").alias("label"))
