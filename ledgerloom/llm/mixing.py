"""Mixing sources to target weights.

The number of output shards follows from the total size (``shard_size`` tokens each), the number of blocks from the number
of shards.  Documents are put into blocks per source by a hash of their id: a block is a random part of its source, and a source
that holds a third of all rows is as many blocks as any other.  Only the blocks' token sums (sources x blocks numbers)
reach the driver.  There the total is set: the largest one for which every source can give its share with no document used
more than ``max_repeats`` times.  A source's quota is so many full passes over its blocks and, of one more pass, whole
blocks in random order and a cut through the last one at the
document nearest to the quota, so shares are met to within half a document.

The drawn (source, pass, block) units are dealt to output shards by a splitting tree: at each node the counts of units per
source that go left are one multivariate hypergeometric draw, which partitions the exact quotas among the shards; the units
themselves are then taken from each source's permutation in that order, and every shard is shuffled locally.

Sources compare trimmed and without case.  Null and empty texts have no size and are not used.  Sources without weight get
no share; a weighted source without documents is reported with none, and the others keep their proportions.  Shares and
repeat limits that are null or not positive count as zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.session import checkpointed

MAX_SOURCES = 10_000
#: blocks of all sources together, whose sums reach the driver; and units of the plan that are broadcast at most
MOST_BLOCKS, MOST_BROADCAST = 2_000_000, 200_000


@dataclass
class Unit:
    source: str
    turn: int
    block: int
    cut: int | None = None  # tokens to take of a block that is cut


def normal_source(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: units of each source per shard, by recursive multivariate hypergeometric splits."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    drawn = rng.multivariate_hypergeometric(counts, round(total * left / shards), method="marginals") if total else counts.copy()
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(counts - drawn, shards - left, rng)])


def plan_units(sizes: dict[str, np.ndarray], shares: dict[str, float], repeats: dict[str, int], rng: np.random.Generator) -> list[Unit]:
    """Units to draw: ``sizes`` gives the token sum of each block of each source."""
    totals = {s: int(b.sum()) for s, b in sizes.items() if b.sum() > 0 and shares.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not totals:
        return []
    whole = min(t * repeats[s] / shares[s] for s, t in totals.items())
    units = []
    for s, t in sorted(totals.items()):
        quota = min(round(whole * shares[s]), t * repeats[s])
        turns, rest = divmod(quota, t)
        filled = [int(b) for b in np.flatnonzero(sizes[s])]
        units += [Unit(s, turn, b) for turn in range(turns) for b in filled]
        for b in rng.permutation(filled):
            if rest <= 0:
                break
            size = int(sizes[s][b])
            units.append(Unit(s, turns, int(b), None if size <= rest else rest))
            rest -= size
    return units


def deal(units: list[Unit], shards: int, rng: np.random.Generator) -> list[tuple[str, int, int, int | None, int]]:
    """(source, turn, block, cut, shard) of every unit."""
    sources = sorted({u.source for u in units})
    own = {s: [u for u in units if u.source == s] for s in sources}
    quotas = split_quotas(np.array([len(own[s]) for s in sources], dtype=np.int64), shards, rng)
    out = []
    for k, s in enumerate(sources):
        order = rng.permutation(len(own[s]))
        ends = np.cumsum(quotas[:, k])
        for at, i in enumerate(order):
            u = own[s][i]
            out.append((u.source, u.turn, u.block, u.cut, int(np.searchsorted(ends, at, side="right"))))
    return out


def mix(docs: DataFrame, weights: DataFrame, key: str, source: str, size: str, shards: int | None = None, blocks: int | None = None, seed: int = 1, shard_size: int = 500_000) -> DataFrame:
    """shard, order_key, key, source, copy, size: the mixture; ``order_key`` is the random order inside a shard.

    ``docs`` holds the sizes (column ``size``, bigint); it is read twice, so it should be written or checkpointed.
    """
    rows = weights.select(normal_source(F.col("source")).alias("s"), "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    shares = {r.s: r.target_share for r in rows if r.s is not None and r.target_share and math.isfinite(r.target_share) and r.target_share > 0}
    repeats = {r.s: r.max_repeats for r in rows if r.max_repeats and r.max_repeats > 0}
    if shards is None:
        shards = max(1, min(50_000, round((docs.agg(F.sum(size)).first()[0] or 0) / shard_size)))
    if blocks is None:  # several units of every source for every shard
        blocks = max(256, min(8 * shards, MOST_BLOCKS // max(len(shares), 1)))
    blocked = docs.select(
        key,
        normal_source(F.col(source)).alias("source"),
        F.col(size).alias("n_tokens"),
        F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).cast("int").alias("block"),
    ).where(F.col("source").isin(sorted(shares)) & (F.col("n_tokens") > 0))
    sizes: dict[str, np.ndarray] = {}
    for r in blocked.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).collect():  # at most sources x blocks rows
        sizes.setdefault(r.source, np.zeros(blocks, dtype=np.int64))[r.block] = r.n
    rng = np.random.default_rng(seed)
    units = deal(plan_units(sizes, shares, repeats, rng), shards, rng) if sizes else []
    plan = docs.sparkSession.createDataFrame(units, "source string, copy int, block int, cut long, shard int")
    drawn = blocked.join(F.broadcast(plan) if len(units) <= MOST_BROADCAST else plan, ["source", "block"])
    cut_at = Window.partitionBy("source", "copy", "block").orderBy("rank", key).rowsBetween(Window.unboundedPreceding, 0)
    parts = drawn.where("cut IS NOT NULL").withColumn("rank", F.xxhash64(F.lit(seed + 1), key, "copy"))
    parts = parts.withColumn("upto", F.sum("n_tokens").over(cut_at)).where("upto - n_tokens / 2 <= cut").drop("rank", "upto")
    mixed = drawn.where("cut IS NULL").unionByName(parts)
    order = F.xxhash64(F.lit(seed + 2), key, "copy").alias("order_key")
    return mixed.select("shard", order, key, "source", "copy", "n_tokens").repartitionById(shards, "shard").sortWithinPartitions("shard", "order_key")


def reached_shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """source, target_share, share, n_tokens, n_rows, most_copies of every weighted source."""
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("copy") + 1).alias("most_copies"))
    total = per.agg(F.sum("n_tokens").alias("all_tokens"))
    return (
        weights.select(normal_source(F.col("source")).alias("source"), "target_share")
        .join(per, "source", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )


def sized(docs: DataFrame) -> DataFrame:
    """Written once, because the mixture reads sizes twice and counting tokens is the costly part."""
    return checkpointed(docs)
