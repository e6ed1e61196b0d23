"""Scalar functions of the query language as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARK_UNIT = {"SECOND": "SECOND", "MINUTE": "MINUTE", "HOUR": "HOUR", "DAY": "DAY", "WEEK": "WEEK", "MONTH": "MONTH", "QUARTER": "QUARTER", "YEAR": "YEAR"}


def begin_of_period(d: Column, unit: str) -> Column:
    """Start of the period a date lies in; ten-day periods start on the 1st, 11th and 21st, half-years in January and July."""
    if unit == "TENDAYS":
        step = F.least(F.floor((F.dayofmonth(d) - 1) / 10), F.lit(2))
        return F.timestamp_add("DAY", (step * 10).cast("int"), F.date_trunc("month", d))
    if unit == "HALFYEAR":
        return F.timestamp_add("MONTH", F.when(F.month(d) > 6, 6).otherwise(0), F.date_trunc("year", d))
    return F.date_trunc(SPARK_UNIT[unit].lower(), d)


def date_add(d: Column, unit: str, n: Column) -> Column:
    """d moved by n units; month ends clamp."""
    n = n.cast("int")
    if unit == "TENDAYS":
        unit, n = "DAY", n * 10
    elif unit == "HALFYEAR":
        unit, n = "MONTH", n * 6
    return F.timestamp_add(SPARK_UNIT[unit], n, d)


def end_of_period(d: Column, unit: str) -> Column:
    """Last second of the period."""
    begin = begin_of_period(d, unit)
    if unit == "TENDAYS":  # the third one ends with the month
        after = F.when(F.dayofmonth(begin) == 21, F.timestamp_add("MONTH", F.lit(1), F.date_trunc("month", d))).otherwise(F.timestamp_add("DAY", F.lit(10), begin))
    else:
        after = date_add(begin, unit, F.lit(1))
    return F.timestamp_add("SECOND", F.lit(-1), after)


def date_diff(a: Column, b: Column, unit: str) -> Column:
    """Number of unit borders between two dates (not whole elapsed units)."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "MONTH":
        return months.cast("bigint")
    if unit == "QUARTER":
        return ((F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)).cast("bigint")
    if unit == "YEAR":
        return (F.year(b) - F.year(a)).cast("bigint")
    if unit == "DAY":
        return F.date_diff(b.cast("date"), a.cast("date")).cast("bigint")
    seconds = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600}[unit]
    whole = lambda x: F.floor(F.unix_timestamp(F.date_trunc(unit.lower(), x)) / seconds)
    return (whole(b) - whole(a)).cast("bigint")


def _date(part):
    return lambda a: part(a[0]).cast("bigint")


SIMPLE = {
    "SUBSTRING": lambda a: F.substring(a[0], a[1], a[2]),
    "LOWER": lambda a: F.lower(a[0]),
    "UPPER": lambda a: F.upper(a[0]),
    "STRINGLENGTH": lambda a: F.char_length(a[0]).cast("bigint"),
    "TRIMALL": lambda a: F.trim(a[0]),
    "TRIML": lambda a: F.ltrim(a[0]),
    "TRIMR": lambda a: F.rtrim(a[0]),
    "LEFT": lambda a: F.left(a[0], a[1]),
    "RIGHT": lambda a: F.right(a[0], a[1]),
    "STRFIND": lambda a: F.position(a[1], a[0]).cast("bigint"),
    "STRREPLACE": lambda a: F.replace(a[0], a[1], a[2]),
    "STRING": lambda a: a[0].cast("string"),
    "YEAR": _date(F.year), "QUARTER": _date(F.quarter), "MONTH": _date(F.month), "DAYOFYEAR": _date(F.dayofyear), "DAY": _date(F.dayofmonth),
    "WEEK": _date(F.weekofyear), "WEEKDAY": lambda a: (F.weekday(a[0]) + 1).cast("bigint"), "HOUR": _date(F.hour), "MINUTE": _date(F.minute), "SECOND": _date(F.second),
    "ACOS": lambda a: F.acos(a[0]), "ASIN": lambda a: F.asin(a[0]), "ATAN": lambda a: F.atan(a[0]), "COS": lambda a: F.cos(a[0]), "SIN": lambda a: F.sin(a[0]), "TAN": lambda a: F.tan(a[0]),
    "LOG": lambda a: F.ln(a[0]), "LOG10": lambda a: F.log10(a[0]), "EXP": lambda a: F.exp(a[0]), "POW": lambda a: F.pow(a[0], a[1]), "SQRT": lambda a: F.sqrt(a[0]),
    "INT": lambda a: a[0].cast("bigint"),
    "ISNULL": lambda a: F.coalesce(a[0], a[1]),
    "UUID": lambda a: a[0].cast("string"),
    "STOREDDATASIZE": lambda a: F.octet_length(a[0]).cast("bigint"),
}
