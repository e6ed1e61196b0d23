"""Parent chains: closure, paths and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed


def closure(df: DataFrame, key: str, parent: str) -> DataFrame:
    """ancestor, descendant, depth of every pair on a parent chain, the row itself at depth 0.

    Pairs are joined with themselves, so a chain of n steps takes log n rounds; the rounds end, in cycles too, when one
    brings no new pair.  Each round is one equi-join, cut off from the lineage.  Null keys are left out, null parents end
    a chain; a key with several parents has the chains of all.
    """
    base = df.select(F.col(key).alias("descendant"), F.col(parent).alias("ancestor")).where("descendant IS NOT NULL")
    known = base.where("ancestor IS NOT NULL AND ancestor <> descendant").withColumn("depth", F.lit(1)).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth"))
    known, size = checkpointed(known), -1
    while (count := known.count()) != size:
        size = count
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.descendant") == F.col("b.ancestor")).select(F.col("a.ancestor").alias("ancestor"), F.col("b.descendant").alias("descendant"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known = checkpointed(known.unionByName(longer.where("ancestor <> descendant")).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
    own = base.select(F.col("descendant").alias("ancestor"), "descendant", F.lit(0).alias("depth")).distinct()
    return own.unionByName(known)


def below(df: DataFrame, key: str, parent: str, roots: DataFrame) -> DataFrame:
    """Keys under the given roots (column ``key``), the roots included: walks down from the roots only, a semi-join of the
    parents with the keys found last in each round, until none is new."""
    links = df.select(F.col(key).alias("key"), F.col(parent).alias("up")).where("key IS NOT NULL AND up IS NOT NULL")
    frontier = checkpointed(roots.select("key").where("key IS NOT NULL").distinct())
    found, pieces = frontier, 1
    while not frontier.isEmpty():
        step = links.join(frontier.select(F.col("key").alias("up")), "up", "left_semi").select("key").distinct()
        frontier = checkpointed(step.join(found, "key", "left_anti"))
        found, pieces = found.unionByName(frontier), pieces + 1
        if pieces == 20:  # keeps the plan short on long chains
            found, pieces = checkpointed(found), 1
    return found


def paths(df: DataFrame, pairs: DataFrame, key: str, name: str) -> DataFrame:
    """key, path (array of names from the root down), level (0 at a root)."""
    named = pairs.join(df.select(F.col(key).alias("ancestor"), F.col(name).alias("n")), "ancestor")
    return named.groupBy(F.col("descendant").alias("key")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "n"))), lambda x: x["n"]).alias("path")).withColumn("level", F.size("path") - 1)
