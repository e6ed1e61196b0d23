"""Parameterised register views.

Every view is one aggregation (or one window) over the register, with the caller's condition on dimensions applied to the
scan, so Catalyst pushes it to parquet.  Totals are hash aggregates with map-side combine; only the running balances use a
window, over rows already aggregated to one per dimension key and period.

Decisions the language leaves open: a balance at a moment excludes that moment (``inclusive=False``); a slice includes it.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import begin_of_period


def slice_last(df: DataFrame, dims: Sequence[str], period: str, at: Column | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The latest row per dimension key up to and including ``at``; later ``ties`` win within one moment.

    ``max_by`` over the whole row: a hash aggregate with map-side combine, so a hot key costs no big sort.
    """
    rows = df if at is None else df.where(F.col(period) <= at)
    return _extreme(rows, dims, [period, *ties], F.max_by)


def slice_first(df: DataFrame, dims: Sequence[str], period: str, at: Column | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """The earliest row per dimension key from ``at`` on."""
    rows = df if at is None else df.where(F.col(period) >= at)
    return _extreme(rows, dims, [period, *ties], F.min_by)


def _extreme(rows: DataFrame, dims: Sequence[str], by: Sequence[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in dims]
    return rows.groupBy(*dims).agg(pick(F.struct(*rest), F.struct(*by)).alias("__row")).select(*dims, *(F.col("__row")[c].alias(c) for c in rest))


def _signed(resource: str, receipt: Column | None) -> Column:
    return F.col(resource) if receipt is None else F.when(receipt, F.col(resource)).otherwise(-F.col(resource))


def balance(df: DataFrame, dims: Sequence[str], resources: Sequence[str], period: str, receipt: Column | None, at: Column | None = None, inclusive: bool = False) -> DataFrame:
    """dims, <resource>_balance at the start of a moment; keys whose balances are all zero are left out."""
    rows = df if at is None else df.where(F.col(period) <= at if inclusive else F.col(period) < at)
    out = rows.groupBy(*dims).agg(*(F.sum(_signed(r, receipt)).alias(f"{r}_balance") for r in resources))
    nonzero = None
    for r in resources:
        test = F.col(f"{r}_balance") != 0
        nonzero = test if nonzero is None else nonzero | test
    return out.where(nonzero) if nonzero is not None else out


def _within(df: DataFrame, period: str, begin: Column | None, end: Column | None) -> DataFrame:
    if begin is not None:
        df = df.where(F.col(period) >= begin)
    return df if end is None else df.where(F.col(period) <= end)


def turnovers(
    df: DataFrame, dims: Sequence[str], resources: Sequence[str], period: str, receipt: Column | None, begin: Column | None = None, end: Column | None = None, unit: str | None = None
) -> DataFrame:
    """dims (and the period's start), <resource>_turnover; with movement kinds also _receipt and _expense."""
    rows = _within(df, period, begin, end)
    keys = [F.col(d) for d in dims] + ([begin_of_period(F.col(period), unit).alias(period)] if unit else [])
    aggs = []
    for r in resources:
        if receipt is not None:
            aggs += [F.sum(F.when(receipt, F.col(r)).otherwise(0)).alias(f"{r}_receipt"), F.sum(F.when(receipt, 0).otherwise(F.col(r))).alias(f"{r}_expense")]
        aggs.append(F.sum(_signed(r, receipt)).alias(f"{r}_turnover"))
    return rows.groupBy(*keys).agg(*aggs)


def balance_and_turnovers(
    df: DataFrame, dims: Sequence[str], resources: Sequence[str], period: str, receipt: Column | None, begin: Column | None = None, end: Column | None = None, unit: str | None = None
) -> DataFrame:
    """dims (and the period's start), opening balance, receipt, expense, turnover, closing balance.

    One pass: movements before ``begin`` are folded into one opening row per key, the others into one row per key and
    period; the running sum then goes over these few rows.
    """
    rows = df if end is None else df.where(F.col(period) <= end)
    before = F.lit(False) if begin is None else F.col(period) < begin
    bucket = F.when(~before, begin_of_period(F.col(period), unit) if unit else F.lit(None).cast(df.schema[period].dataType))
    aggs = []
    for r in resources:
        plus = F.col(r) if receipt is None else F.when(receipt, F.col(r)).otherwise(0)
        minus = F.lit(0) if receipt is None else F.when(receipt, 0).otherwise(F.col(r))
        aggs += [F.sum(plus).alias(f"{r}_receipt"), F.sum(minus).alias(f"{r}_expense"), F.sum(_signed(r, receipt)).alias(f"{r}_turnover")]
    cells = rows.groupBy(*dims, before.alias("__before"), bucket.alias("__bucket")).agg(*aggs)
    w = Window.partitionBy(*dims).orderBy(F.col("__before").desc(), F.col("__bucket").asc())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = cells
    for r in resources:
        out = out.withColumn(f"{r}_closing", F.sum(f"{r}_turnover").over(upto))
    for r in resources:
        out = out.withColumn(f"{r}_opening", F.col(f"{r}_closing") - F.col(f"{r}_turnover"))
    columns = [F.col(d) for d in dims] + ([F.col("__bucket").alias(period)] if unit else [])
    for r in resources:
        columns += [F.col(f"{r}_{k}") for k in ("opening", "receipt", "expense", "turnover", "closing")]
    last = out.where(~F.col("__before"))
    if not unit:  # keys that only had movements before the interval still have a balance
        only = Window.partitionBy(*dims)
        last = out.withColumn("__n", F.count(F.when(~F.col("__before"), 1)).over(only)).where(~F.col("__before") | (F.col("__n") == 0))
        for r in resources:
            for k in ("receipt", "expense", "turnover"):
                last = last.withColumn(f"{r}_{k}", F.when(F.col("__before"), F.lit(0)).otherwise(F.col(f"{r}_{k}")))
            last = last.withColumn(f"{r}_opening", F.when(F.col("__before"), F.col(f"{r}_closing")).otherwise(F.col(f"{r}_opening")))
    return last.select(*columns)


def dr_cr_turnovers(df: DataFrame, debit: str, credit: str, dims: Sequence[str], resources: Sequence[str], period: str, begin=None, end=None, unit: str | None = None) -> DataFrame:
    """Turnovers between debit and credit accounts."""
    return turnovers(df, [debit, credit, *dims], resources, period, None, begin, end, unit)


def boundaries(df: DataFrame, dims: Sequence[str], period: str) -> DataFrame:
    """The latest moment per key of a sequence."""
    return df.groupBy(*dims).agg(F.max(period).alias(period))


def ext_dimensions(df: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One row per posting and analytic dimension: keys, kind, value."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in kinds))
    return df.select(*keys, F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def records_with_ext_dimensions(df: DataFrame, ext: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Postings with their analytic dimensions as columns."""
    wide = ext.groupBy(*keys).pivot("kind", list(kinds)).agg(F.first("value"))
    return df.join(wide, list(keys), "left")


def actual_action_period(df: DataFrame, keys: Sequence[str], begin: str, end: str, priority: str) -> DataFrame:
    """keys, begin, end of what is left of each interval after those of a higher priority of the same key displaced it.

    Borders of all intervals of a key cut time into elementary pieces; a piece belongs to the covering interval of the
    highest priority, and neighbouring pieces of one interval are joined again.  Intervals are half open.
    """
    ided = df.select(*keys, F.col(begin).alias("__b"), F.col(end).alias("__e"), F.col(priority).alias("__p"), F.xxhash64(*keys, begin, end, priority).alias("__id")).where("__b < __e")
    points = ided.select(*keys, F.explode(F.array("__b", "__e")).alias("x")).distinct()
    w = Window.partitionBy(*keys).orderBy("x")
    pieces = points.withColumn("y", F.lead("x").over(w)).where("y IS NOT NULL")
    covered = pieces.join(ided, list(keys)).where("__b <= x AND y <= __e")
    winner = covered.groupBy(*keys, "x", "y").agg(F.max_by("__id", F.struct("__p", "__id")).alias("__id"))
    order = Window.partitionBy(*keys, "__id").orderBy("x")
    run = winner.withColumn("new", F.when(F.lag("y").over(order) == F.col("x"), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return run.groupBy(*keys, "__id", "run").agg(F.min("x").alias(begin), F.max("y").alias(end)).join(ided.select("__id", F.col("__p").alias(priority)).distinct(), "__id").select(*keys, priority, begin, end)


def schedule_data(df: DataFrame, schedule: DataFrame, keys: Sequence[str], begin: str, end: str, day: str, value: str) -> DataFrame:
    """df with the schedule's sum of ``value`` over the days from ``begin`` to ``end`` (both included).

    Prefix sums of the schedule turn the range join into two as-of look-ups on (keys, day): each row meets exactly two
    schedule rows instead of every day of its interval.
    """
    daily = schedule.groupBy(*keys, F.col(day).cast("timestamp_ntz").alias("at")).agg(F.sum(value).alias("v"))
    ided = df.withColumn("__id", F.monotonically_increasing_id())
    ends = ided.select(*keys, "__id", F.inline(F.array(F.struct(F.col(begin).cast("timestamp_ntz").alias("at"), F.lit(0).alias("side")), F.struct(F.col(end).cast("timestamp_ntz").alias("at"), F.lit(1).alias("side")))))
    facts = daily.select(*keys, "at", "v", F.lit(None).cast("bigint").alias("__id"), F.lit(None).cast("int").alias("side"))
    asks = ends.select(*keys, "at", F.lit(None).cast("double").alias("v"), "__id", "side")
    both = facts.select(*keys, "at", F.col("v").cast("double").alias("v"), "__id", "side").unionByName(asks)
    # a begin counts what lies before it, an end what lies up to it
    rank = F.when(F.col("side") == 0, 0).when(F.col("side").isNull(), 1).otherwise(2)
    sums = both.withColumn("upto", F.sum("v").over(Window.partitionBy(*keys).orderBy("at", rank).rowsBetween(Window.unboundedPreceding, 0))).where("side IS NOT NULL")
    per = sums.groupBy("__id").agg((F.coalesce(F.max(F.when(F.col("side") == 1, F.col("upto"))), F.lit(0.0)) - F.coalesce(F.max(F.when(F.col("side") == 0, F.col("upto"))), F.lit(0.0))).alias(value))
    return ided.join(per, "__id").drop("__id")


def tasks_by_performer(tasks: DataFrame, addressing: DataFrame, attributes: Sequence[str], performer: str) -> DataFrame:
    """Tasks with the performers whose addressing row matches; a null attribute of the addressing row matches all.

    Addressing rows are told apart by which of their attributes are null: each kind is an equi-join on the others, and
    performers without any attribute are handed to every task as one list.
    """
    out = None
    for given in itertools.product((True, False), repeat=len(attributes)):
        mask = [F.col(a).isNotNull() if g else F.col(a).isNull() for a, g in zip(attributes, given)]
        rows = addressing.where(reduce(lambda a, b: a & b, mask)) if mask else addressing
        on = [a for a, g in zip(attributes, given) if g]
        if on:
            part = tasks.join(rows.select(*on, performer), on).select(*tasks.columns, performer)
        else:
            part = tasks.select("*", F.explode(rows.select(F.collect_set(performer)).scalar()).alias(performer))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def period_starts(unit: str, begin: Column, end: Column) -> Column:
    """All period starts from begin to end, as an array: what gaps are filled from."""
    step = {"TENDAYS": "1 day", "HALFYEAR": "6 months", "QUARTER": "3 months", "WEEK": "7 days"}.get(unit, f"1 {unit.lower()}")
    days = F.sequence(begin_of_period(begin, unit), end, F.expr(f"interval {step}"))
    return F.array_distinct(F.transform(days, lambda d: begin_of_period(d, unit)))
