"""Differences of two states of a table of keyed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, change ('added', 'removed', 'modified'), fields: one full join on digests of the values."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*keys, F.struct(*values).alias(tag))

    both = side(old, "o").join(side(new, "n"), list(keys), "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    touched = F.filter(F.array(*(F.when(~F.col("o")[v].eqNullSafe(F.col("n")[v]), F.lit(v)) for v in values)), lambda x: x.isNotNull())
    fields = F.when(change == "modified", touched).otherwise(F.array().cast("array<string>"))
    return both.where(F.col("o").isNull() | F.col("n").isNull() | (F.size(touched) > 0)).select(*keys, change.alias("change"), fields.alias("fields"))


def child_sets(old: DataFrame, new: DataFrame, key: str, children: str) -> DataFrame:
    """key, added and removed children (sorted) of records in both states whose sets differ."""
    both = old.select(key, F.col(children).alias("o")).join(new.select(key, F.col(children).alias("n")), key)
    out = both.select(key, F.array_sort(F.array_except("n", "o")).alias("added"), F.array_sort(F.array_except("o", "n")).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def baseline(known: DataFrame, now: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, state: 'new' or 'fixed' findings against a baseline."""
    new = now.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti").withColumn("state", F.lit("new"))
    fixed = known.select(*keys).distinct().join(now.select(*keys), list(keys), "left_anti").withColumn("state", F.lit("fixed"))
    return new.unionByName(fixed)


def change_counts(changes: DataFrame, kind: str) -> DataFrame:
    """Per kind of record: how many were added, removed and modified."""
    count = lambda what: F.count(F.when(F.col("change") == what, 1)).alias(what)
    return changes.groupBy(kind).agg(count("added"), count("removed"), count("modified"))


def text_report(changes: DataFrame, key: str) -> DataFrame:
    """One readable line per change, in the order of the keys."""
    mark = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    fields = F.when(F.size("fields") > 0, F.concat(F.lit(" ("), F.array_join("fields", ", "), F.lit(")"))).otherwise("")
    return changes.orderBy(key).select(F.concat(mark, F.lit(" "), F.col(key).cast("string"), fields).alias("value"))
