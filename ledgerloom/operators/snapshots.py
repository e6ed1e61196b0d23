"""What changed between full snapshots.

A snapshot is read in the order of its keys' hashes and cut into content-defined chunks: the keys whose hashes begin with
the same bits.  A key's chunk depends on nothing but the key, so records that come or go move no other chunk's border, and
every chunk is about equally large whatever the keys look like.  No row moves for that: each task sums up, per chunk and
version, an order-free digest of its (key, content) pairs, and only these digests are shuffled.  Chunks whose digests agree
in two consecutive snapshots are discarded; the rows of the others, reduced to key, version and content digest, are brought
together by key and classified against their neighbour version.

If a snapshot holds a key more than once the latest delivery counts (the larger id on a tie).  Which keys are repeated is
found by counting their hashes alone, eight bytes a row: their chunks never count as matching, and only there a row brings
the order of its delivery along.  Rows without
key or version number belong to no snapshot.  Fewer than two snapshots give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stored

SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: a text that holds neither two blanks in a row nor one of these needs no cleaning but at its ends
RARE = r"[^ -~\u00a1-\u167f]"
MAX_VERSIONS = 10_000
#: chunks times versions; bounds what is compared, and what is broadcast, at any number of rows
MOST_DIGESTS = 1 << 20


def normal_text(c: Column) -> Column:
    """Null as the empty string, white space trimmed and collapsed."""
    text = F.coalesce(c, F.lit(""))
    odd = F.contains(text, F.lit("  ")) | text.rlike(RARE)
    return F.when(odd, F.trim(F.regexp_replace(text, SPACE, " "))).otherwise(F.trim(text))


def normal_json(c: Column) -> Column:
    """The JSON value with its keys in order; the normal text if it does not parse."""
    return F.coalesce(F.concat(F.lit("\u0001"), F.to_json(F.try_parse_json(c))), normal_text(c))


def version_number(c: Column) -> Column:
    """A dotted number as an array that compares part by part."""
    return F.transform(F.split(c, r"\."), lambda p: p.try_cast("long") if hasattr(p, "try_cast") else p.cast("long"))


def snapshot_sizes(df: DataFrame, version: str) -> list[tuple[str, int]]:
    """(version, rows) by version number.  The list is bounded: more than MAX_VERSIONS raise."""
    seen = df.select(normal_text(F.col(version)).alias("v")).where(r"v RLIKE '^[0-9]+([.][0-9]+)*$'").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.orderBy(version_number(F.col("v"))).limit(MAX_VERSIONS + 1).collect()
    if len(rows) > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} versions")
    return [(r.v, r.n) for r in rows]


def _chunk_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


def chunk_digests(narrow: DataFrame, bits: int) -> DataFrame:
    """c, v, n, x, y: per chunk and version the number of rows and two order-free digests."""
    parts = narrow.select(_chunk_of(F.col("k"), bits).alias("c"), "v", F.xxhash64("k").alias("h"), "d")
    return parts.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h", "d")).alias("x"), F.bit_xor(F.xxhash64("d", "h")).alias("y"))


def repeating_chunks(narrow: DataFrame, bits: int) -> DataFrame:
    """c, repeats: the versions in which a chunk holds a key more than once."""
    again = narrow.groupBy("v", F.xxhash64("k").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunk = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    return again.select(chunk.alias("c"), "v").distinct().groupBy("c").agg(F.collect_list("v").alias("repeats"))


def unmatched_chunks(digests: DataFrame, repeating: DataFrame, n_pairs: int) -> DataFrame:
    """c, pairs, repeats: the chunks to look into, the numbers of the version pairs they differ in, and the versions in
    which a key may be there twice."""
    side = digests.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("v", F.struct("n", "x", "y")))).alias("by")).join(repeating, "c", "left")
    twice = lambda i: F.coalesce(F.array_contains("repeats", i), F.lit(False))
    differs = lambda i: ~F.try_element_at("by", i).eqNullSafe(F.try_element_at("by", i + 1)) | twice(i) | twice(i + 1)
    pairs = F.filter(F.sequence(F.lit(0), F.lit(n_pairs - 1)), differs)
    return side.select("c", pairs.alias("pairs"), F.coalesce("repeats", F.array().cast("array<int>")).alias("repeats")).where(F.size("pairs") > 0)


def snapshot_changes(
    df: DataFrame,
    version: str,
    key: str,
    order: Sequence[str],
    texts: Sequence[str],
    jsons: Sequence[str] = (),
    chunk_rows: int = 64,
) -> DataFrame:
    """version_from, version_to, key, change ("added", "removed", "changed") for each pair of consecutive versions.

    A chunk holds ``chunk_rows`` keys on average: many more than a snapshot has tasks, so that digests are summed where rows
    lie, and few enough that a changed record brings few others along.
    """
    sizes = snapshot_sizes(df, version)
    if len(sizes) < 2:
        return df.limit(0).select(F.lit("").alias("version_from"), F.lit("").alias("version_to"), F.col(key), F.lit("").alias("change"))
    names = [v for v, _ in sizes]
    chunks = min(MOST_DIGESTS // len(names), max(n for _, n in sizes) // chunk_rows)
    bits = max(0, chunks.bit_length() - 1)
    content = [normal_text(F.col(c)) for c in texts] + [normal_json(F.col(c)) for c in jsons]
    ranks = F.create_map(*(F.lit(x) for i, v in enumerate(names) for x in (v, i)))
    narrow = stored(
        df.where(F.col(key).isNotNull())
        .select(
            F.try_element_at(ranks, normal_text(F.col(version))).alias("v"), F.col(key).alias("k"), F.struct(*order).alias("o"),
            F.unhex(F.substring(F.sha2(F.concat_ws("\u0002", *content), 256), 1, 32)).alias("d"),
        )
        .where("v IS NOT NULL")
    )
    found = stored(unmatched_chunks(chunk_digests(narrow, bits), repeating_chunks(narrow, bits), len(names) - 1))
    need = F.broadcast(found)  # at most MOST_DIGESTS entries
    moved = narrow.withColumn("c", _chunk_of(F.col("k"), bits)).join(need, "c").where(F.array_contains("pairs", F.col("v")) | F.array_contains("pairs", F.col("v") - 1))
    order_of = F.when(F.array_contains("repeats", F.col("v")), F.col("o"))
    w = Window.partitionBy("k").orderBy("v", "o")
    # of a key's deliveries in one version, side by side in the order of their delivery, the last one stays
    rows = moved.select("k", "v", "d", order_of.alias("o")).withColumn("later", F.lead("v").over(w)).where(~F.col("later").eqNullSafe(F.col("v")))
    near = rows.withColumns({"before": F.lag(F.struct("v", "d")).over(w), "after": F.lead("v").over(w)})
    there = F.col("before.v").eqNullSafe(F.col("v") - 1)
    # a pair is judged at its later version, but for what was removed
    at_end = F.when(~there, "added").when(F.col("before.d") != F.col("d"), "changed")
    events = F.array(F.struct((F.col("v") - 1).alias("i"), at_end.alias("change")), F.struct(F.col("v").alias("i"), F.when(~F.col("after").eqNullSafe(F.col("v") + 1), "removed").alias("change")))
    told = near.select(_chunk_of(F.col("k"), bits).alias("c"), "k", F.explode(F.filter(events, lambda e: e["change"].isNotNull())).alias("e")).join(need, "c").where(F.array_contains("pairs", F.col("e.i")))
    listed = F.array(*(F.lit(v) for v in names))
    return told.select(F.get(listed, F.col("e.i")).alias("version_from"), F.get(listed, F.col("e.i") + 1).alias("version_to"), F.col("k").alias(key), F.col("e.change").alias("change"))
