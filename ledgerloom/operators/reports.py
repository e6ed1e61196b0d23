"""Report composition: data sets, links, calculated fields, totals, cross tables and field lineage."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy

# fixed values: comparison kinds of report filters
FILTERS = {
    "Equal": lambda c, v: c == v, "NotEqual": lambda c, v: c != v, "Greater": lambda c, v: c > v, "GreaterOrEqual": lambda c, v: c >= v, "Less": lambda c, v: c < v, "LessOrEqual": lambda c, v: c <= v,
    "InList": lambda c, v: c.isin(list(v)), "NotInList": lambda c, v: ~c.isin(list(v)), "Contains": lambda c, v: c.contains(v), "NotContains": lambda c, v: ~c.contains(v),
    "BeginsWith": lambda c, v: c.startswith(v), "NotBeginsWith": lambda c, v: ~c.startswith(v), "Filled": lambda c, v: c.isNotNull() & (c.cast("string") != ""), "NotFilled": lambda c, v: c.isNull() | (c.cast("string") == ""),
}
# fixed values: total functions, Russian and English
TOTALS = {"сумма": F.sum, "sum": F.sum, "количество": F.count, "count": F.count, "максимум": F.max, "maximum": F.max, "минимум": F.min, "minimum": F.min, "среднее": F.avg, "average": F.avg}


def union_set(parts: Sequence[DataFrame]) -> DataFrame:
    """A union data set: columns by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def link(left: DataFrame, right: DataFrame, source: str, target: str) -> DataFrame:
    """Link of two data sets: every row of the left one, with what the right one has for it."""
    r = right.select(*[F.col(c).alias(c if c not in left.columns else f"{c}_linked") for c in right.columns])
    key = target if target not in left.columns else f"{target}_linked"
    return left.join(r, F.col(source) == F.col(key), "left")


def report_filter(tree: tuple) -> Column:
    """('and'|'or'|'not', parts...) or (field, kind, value) as a condition; for hierarchies see ``in_hierarchy``."""
    head = tree[0].lower()
    if head in ("and", "or"):
        out = report_filter(tree[1])
        for t in tree[2:]:
            out = out & report_filter(t) if head == "and" else out | report_filter(t)
        return out
    if head == "not":
        return ~report_filter(tree[1])
    field, kind, *value = tree
    return FILTERS[kind](F.col(field), value[0] if value else None)


# fixed values: types of report parameters
PARAMETER_TYPES = {"string": "string", "number": "decimal(38,10)", "boolean": "boolean", "date": "timestamp_ntz"}
ROLES = ("dimension", "account", "balance", "period", "resource")


def in_hierarchy(df: DataFrame, field: str, nodes: DataFrame, key: str, parent: str, roots: DataFrame) -> DataFrame:
    """Rows whose field lies under one of the roots (filters InHierarchy, with one root, and InListByHierarchy)."""
    under = hierarchy.below(nodes, key, parent, roots)
    return df.join(under.select(F.col("key").alias(field)), field, "left_semi").select(*df.columns)


def calculated(df: DataFrame, fields: dict[str, str], functions: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Calculated fields in their order, each an SQL expression over the fields before it.

    ``functions`` are functions of the caller's own, used as ``name(field, ...)`` alone; they build columns, so that they run
    on the JVM.
    """
    for name, text in fields.items():
        call = re.fullmatch(r"\s*(\w+)\((.*)\)\s*", text)
        if functions and call and call[1] in functions:
            df = df.withColumn(name, functions[call[1]](*(F.expr(a) for a in call[2].split(",") if a.strip())))
        else:
            df = df.withColumn(name, F.expr(text))
    return df


def parameters(given: dict, declared: dict[str, tuple[str, object]]) -> dict[str, Column]:
    """Values of a report's declared parameters (name -> type, default) as typed columns; a default may be an SQL expression
    that begins with an equals sign; unknown names and missing values without a default raise."""
    unknown = set(given) - set(declared)
    if unknown:
        raise ValueError(f"no parameter {', '.join(sorted(unknown))}")
    out = {}
    for name, (kind, default) in declared.items():
        value = given.get(name, default)
        if value is None:
            raise ValueError(f"parameter {name} has no value")
        column = F.expr(value[1:]) if isinstance(value, str) and value.startswith("=") and name not in given else F.lit(value)
        out[name] = column.cast(PARAMETER_TYPES[kind])
    return out


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The fields' roles as metadata of the columns."""
    odd = {r for r in roles.values() if r not in ROLES} | {c for c in roles if c not in df.columns}
    if odd:
        raise ValueError(f"no such role or field: {', '.join(sorted(odd))}")
    return df.withColumns({c: F.col(c).alias(c, metadata={"role": r}) for c, r in roles.items()})


def fields_of_role(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get("role") == role]


def compose(df: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """Groups by the dimensions (or those given) with the sums of the resources, as the fields' roles say."""
    by = list(groups) if groups is not None else fields_of_role(df, "dimension")
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in fields_of_role(df, "resource")))


def grouped(df: DataFrame, groups: Sequence[str], totals: dict[str, tuple[str, str]], overall: bool = True) -> DataFrame:
    """Nested groups with totals at every level in one aggregation; ``level`` counts from 0 (overall)."""
    aggs = [TOTALS[f.lower()](c).alias(n) for n, (f, c) in totals.items()]
    out = df.rollup(*groups).agg(*aggs, F.grouping_id(*groups).alias("gid")).withColumn("level", (len(groups) - F.bit_count("gid")).cast("int")).drop("gid")
    return out if overall else out.where("level > 0")


def cross_table(df: DataFrame, rows: Sequence[str], column: str, function: str, value: str, values: Sequence) -> DataFrame:
    """Rows by columns; the column values are given, so no extra pass looks for them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(TOTALS[function.lower()](value))


def chart(df: DataFrame, point: str, series: str, function: str, value: str) -> DataFrame:
    return df.groupBy(point, series).agg(TOTALS[function.lower()](value).alias("value"))


def lineage(fields: DataFrame, wanted: str) -> DataFrame:
    """Parts of a schema that a field passes through: by name, else by exact title, else by part of a title.

    ``fields``: schema, part ('dataset', 'calculated', 'total'), name, title, expression.
    """
    low = F.lower(F.lit(wanted))
    how = F.when(F.lower("name") == low, 1).when(F.lower("title") == low, 2).when(F.lower("title").contains(low), 3)
    hits = fields.withColumn("how", how)
    w = Window.partitionBy("schema")
    best = hits.withColumn("best", F.min("how").over(w)).where("how = best")
    names = best.select("schema", F.col("name").alias("hit")).distinct()
    uses = fields.join(names, "schema").where(F.col("part").isin("calculated", "total") & F.col("expression").contains(F.col("hit")) & (F.col("name") != F.col("hit")))
    direct = best.select("schema", "part", "name", "expression", F.lit("match").alias("link"))
    return direct.unionByName(uses.select("schema", "part", "name", "expression", F.lit("uses").alias("link"))).distinct()
