"""From syntax trees to DataFrames.

Nothing is executed here but what totals and hierarchies must know; every statement becomes one lazy plan, and Catalyst
chooses joins, pushes filters and prunes columns.  Columns of each source get a name of their own, so self-joins and
correlated subqueries never clash.  Chains of references become left joins, one per distinct prefix.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, fields, is_dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import hierarchy
from ledgerloom.operators import virtual_tables as vt
from ledgerloom.plans import ast
from ledgerloom.plans.catalog import KINDS, VIRTUAL, Catalog, TableDef
from ledgerloom.plans.parser import AGGREGATES, Parser, parse
from ledgerloom.session import checkpointed

SELF = ("ref", "ссылка")
# fixed values: endings of virtual-table columns, English and Russian
SUFFIX = {"balance": "остаток", "turnover": "оборот", "receipt": "приход", "expense": "расход", "opening": "начальныйостаток", "closing": "конечныйостаток"}


class PlanProblem(ValueError):
    """A name that cannot be resolved, or a construct out of place; carries the code of static validation."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Binding:
    alias: str
    columns: dict[str, str]  # lower-case logical name -> internal column
    shown: dict[str, str]  # internal column -> name in results
    refs: dict[str, str] = field(default_factory=dict)  # internal column -> logical table
    presentation: str | None = None
    composites: dict[str, list[str]] = field(default_factory=dict)  # lower-case name of a field of several types -> internal columns


def walk(node: Any):
    """All nodes of a tree, without entering subqueries."""
    yield node
    if isinstance(node, ast.Query):
        return
    if is_dataclass(node):
        for f in fields(node):
            yield from walk(getattr(node, f.name))
    elif isinstance(node, (list, tuple)):
        for x in node:
            yield from walk(x)


def conjuncts(e: Any) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, ast.Binary) and e.op == "AND" else [e]


class Engine:
    """Runs batches of the query language over a catalog."""

    def __init__(self, spark: SparkSession, catalog: Catalog):
        self.spark, self.catalog = spark, catalog
        self._ids = itertools.count(1)
        self._closures: dict[str, DataFrame] = {}

    def run_all(self, text: str, params: dict[str, Any] | None = None) -> list[DataFrame]:
        """Results of all SELECT statements of a batch, in order; temporary tables live for the batch."""
        temps: dict[str, DataFrame] = {}
        out = []
        for statement in parse(text):
            if isinstance(statement, ast.Drop):
                if statement.name.upper() not in temps:
                    raise PlanProblem("TABLE_NOT_FOUND", statement.name)
                del temps[statement.name.upper()]
                continue
            df = QueryBuilder(self, params or {}, temps, None).query(statement)
            into = next((s.into for _, s in statement.branches if s.into), None)
            if into:
                add = any(s.add for _, s in statement.branches)
                temps[into.upper()] = temps[into.upper()].unionByName(df) if add and into.upper() in temps else df
            else:
                out.append(df)
        return out

    def run(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Result of the last SELECT of a batch."""
        results = self.run_all(text, params)
        if not results:
            raise PlanProblem("EMPTY_QUERY", "the batch returns nothing")
        return results[-1]

    def closure(self, t: TableDef) -> DataFrame:
        if t.name not in self._closures:
            self._closures[t.name] = hierarchy.closure(t.df, t.key, t.parent)
        return self._closures[t.name]


class QueryBuilder:
    def __init__(self, engine: Engine, params: dict, temps: dict, outer: SelectBuilder | None):
        self.engine, self.params, self.temps, self.outer = engine, params, temps, outer

    def query(self, q: ast.Query) -> DataFrame:
        b = SelectBuilder(self, q.branches[0][1])
        if len(q.branches) == 1:
            df = b.build(q.order, q.autoorder)
        else:
            df = b.build([], False)
            for whole, s in q.branches[1:]:
                right = SelectBuilder(self, s).build([], False)
                df = df.union(right.toDF(*df.columns))
                if not whole:
                    df = df.distinct()
            if q.order or q.autoorder:
                df = df.orderBy(*[self._output_order(df, e, desc) for e, desc, _ in q.order] or df.columns)
        first = q.branches[0][1]
        if first.index:  # a temporary table's index: placement for later joins
            cols = [n.parts[-1] for n in first.index if isinstance(n, ast.Name)]
            known = {c.lower(): c for c in df.columns}
            cols = [known[c.lower()] for c in cols if c.lower() in known]
            df = df.repartition(*cols) if cols else df
        return self.totals(df, q, b) if q.totals is not None else df

    def _output_order(self, df: DataFrame, e: Any, desc: bool) -> Column:
        known = {c.lower(): c for c in df.columns}
        if isinstance(e, ast.Lit) and isinstance(e.value, int):
            name = df.columns[e.value - 1]
        elif isinstance(e, ast.Name) and e.parts[-1].lower() in known:
            name = known[e.parts[-1].lower()]
        else:
            raise PlanProblem("FIELD_NOT_FOUND", "a union is ordered by its columns")
        return F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_first()

    # -- TOTALS
    def totals(self, df: DataFrame, q: ast.Query, first: SelectBuilder) -> DataFrame:
        """Detail rows and total rows in one result; ``totals_level`` is 0 overall, i for the i-th group, null for detail.

        The levels above the first hierarchical group come from one aggregation over grouping sets.  From there on a row
        counts for each of its ancestors, so each further set of hierarchical groups has an aggregation of its own, over
        rows joined with the closure of the table the group's column refers to.  ``HIERARCHY`` gives totals of all nodes,
        ``ONLY HIERARCHY`` of those that have others below them.
        """
        known = {c.lower(): c for c in df.columns}

        def name_of(e: Any) -> str:
            if isinstance(e, ast.Name) and e.parts[-1].lower() in known:
                return known[e.parts[-1].lower()]
            raise PlanProblem("FIELD_NOT_FOUND", "totals refer to columns of the result")

        groups = [name_of(t.expr) for t in q.totals_by]
        aggs = {}
        for f in q.totals:
            if isinstance(f.expr, ast.Call) and f.expr.func in AGGREGATES:
                target = f.alias or (name_of(f.expr.args[0]) if isinstance(f.expr.args[0], ast.Name) else None)
                aggs[known.get((target or "").lower(), target)] = self._total(f.expr, name_of)
            else:
                aggs[name_of(f.expr)] = F.sum(name_of(f.expr))
        source = df
        for t, g in zip(q.totals_by, groups):
            if t.periods:
                source = source.withColumn(g, scalar.begin_of_period(F.col(g), t.periods[0]))
        levels: dict[tuple[int, ...], list[int]] = {}  # hierarchical groups in a prefix -> lengths of the prefixes
        for n in range(0 if q.overall or not groups else 1, len(groups) + 1):
            levels.setdefault(tuple(i for i in range(n) if q.totals_by[i].hierarchy), []).append(n)
        total = None
        for climbing, sizes in levels.items():
            rows = source
            for i in climbing:
                rows = self._climb(rows, groups[i], first.referred_table(groups[i]), q.totals_by[i].hierarchy == "only")
            part = self._grouped(rows, df, groups, sizes, aggs)
            total = part if total is None else total.unionByName(part)
        for i, (t, g) in enumerate(zip(q.totals_by, groups)):
            if t.periods:
                total = self._densify(total, groups, i, t.periods)
        whole = total.unionByName(df.withColumn("totals_level", F.lit(None).cast("bigint")))
        # a total stands before the rows it sums up
        return whole.orderBy(*[F.col(g).asc_nulls_first() for g in groups], F.col("totals_level").asc_nulls_last())

    def _climb(self, rows: DataFrame, g: str, t: TableDef, only: bool) -> DataFrame:
        """Every row once for each node its column ``g`` lies under, the node in place of it."""
        pairs = self.engine.closure(t)
        if only:
            pairs = pairs.join(pairs.where("depth > 0").select("ancestor").distinct(), "ancestor", "left_semi")
        pairs = pairs.select(F.col("ancestor").alias("__up"), F.col("descendant").alias("__down"))
        return rows.join(pairs, F.col(f"`{g}`") == F.col("__down")).withColumn(g, F.col("__up")).select(*(f"`{c}`" for c in rows.columns))

    def _grouped(self, rows: DataFrame, df: DataFrame, groups: list[str], sizes: list[int], aggs: dict[str, Column]) -> DataFrame:
        """Totals of the prefixes of ``groups`` with the given lengths."""
        out_aggs = [c.alias(f"__agg_{n}") for n, c in aggs.items()]
        if groups:
            grouped = rows.groupingSets([[F.col(f"`{x}`") for x in groups[:n]] for n in sizes], *groups).agg(*out_aggs, F.grouping_id(*groups).alias("__gid"))
            level = F.lit(len(groups)) - F.bit_count("__gid")
        else:
            grouped, level = rows.agg(*out_aggs), F.lit(0)
        cols = []
        for c in df.columns:
            kind = df.schema[c].dataType
            cols.append(F.col(f"`{c}`") if c in groups else F.col(f"`__agg_{c}`").cast(kind).alias(c) if c in aggs else F.lit(None).cast(kind).alias(c))
        return grouped.select(*cols, level.cast("bigint").alias("totals_level"))

    def _total(self, call: ast.Call, name_of) -> Column:
        arg = F.lit(1) if isinstance(call.args[0], ast.Star) else F.col(name_of(call.args[0]))
        return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count_distinct if call.distinct else F.count}[call.func](arg)

    def _densify(self, total: DataFrame, groups: list[str], at: int, periods: tuple) -> DataFrame:
        """Total rows of the group ``at`` for every period between the borders, for each value of the groups before it."""
        unit, low, high = periods
        g, before = groups[at], groups[:at]
        value = lambda e: SelectBuilder(self, ast.Select([], [])).expr(e)
        rows = total.where(F.col("totals_level") == at + 1)
        if low is None or high is None:
            edge = rows.agg(F.min(g).alias("a"), F.max(g).alias("b")).first()
            if edge.a is None:
                return total
        begin = value(low) if low is not None else F.lit(edge.a)
        end = value(high) if high is not None else F.lit(edge.b)
        kind = total.schema[g].dataType
        starts = F.explode(vt.period_starts(unit, begin.cast(kind), end.cast(kind))).alias(g)
        keys = [*before, g]
        all_ = (rows.select(*before).distinct() if before else self.engine.spark.range(1)).select(*before, starts)
        same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
        pick = [F.lit(at + 1).cast("bigint").alias(c) if c == "totals_level" else F.col(f"{'a' if c in keys else 'r'}.`{c}`") for c in total.columns]
        filled = all_.alias("a").join(rows.alias("r"), same, "left").select(*pick)
        outside = rows.alias("r").join(all_.alias("a"), same, "left_anti")
        return total.where(F.col("totals_level") != at + 1).unionByName(filled).unionByName(outside)


class SelectBuilder:
    """One SELECT."""

    def __init__(self, qb: QueryBuilder, s: ast.Select):
        self.qb, self.s = qb, s
        self.engine, self.params, self.temps = qb.engine, qb.params, qb.temps
        self.bindings: list[Binding] = []
        self.df: DataFrame | None = None
        self.derefs: dict[tuple[str, str], Binding] = {}
        self.owners: dict[str, Binding] = {}  # logical table -> its binding
        self.replaced: dict[str, Column] = {}  # canonical expression -> column after aggregation

    # -- sources
    def bind(self, alias: str, df: DataFrame, logical: dict[str, str], refs: dict[str, str], key: str | None, presentation: str | None) -> tuple[DataFrame, Binding]:
        n = next(self.engine._ids)
        internal = {c: f"s{n}__{c}" for c in df.columns}
        b = Binding(alias.lower(), {k: internal[v] for k, v in logical.items() if v in internal}, {internal[c]: c for c in df.columns}, {internal[c]: t for c, t in refs.items() if c in internal})
        if key:
            b.columns |= {s: internal[key] for s in SELF}
        b.presentation = internal.get(presentation)
        return df.select(*(F.col(f"`{c}`").alias(internal[c]) for c in df.columns)), b

    def source(self, src: Any) -> tuple[DataFrame, list[Binding]]:
        if isinstance(src, ast.Join):
            return self.join(src)
        if isinstance(src, ast.Derived):
            df = QueryBuilder(self.engine, self.params, self.temps, self.qb.outer).query(src.query)
            df, b = self.bind(src.alias, df, {c.lower(): c for c in df.columns}, {}, None, None)
            return df, [b]
        if src.param:
            df = self.params[src.parts[0]]
            df, b = self.bind(src.alias or src.parts[0], df, {c.lower(): c for c in df.columns}, {}, None, None)
            return df, [b]
        if len(src.parts) == 1:
            df = self.temps.get(src.parts[0].upper())
            if df is None:
                raise PlanProblem("TABLE_NOT_FOUND", src.parts[0])
            df, b = self.bind(src.alias or src.parts[0], df, {c.lower(): c for c in df.columns}, {}, None, None)
            return df, [b]
        found = self.engine.catalog.find(src.parts)
        if not found:
            raise PlanProblem("TABLE_NOT_FOUND", ".".join(src.parts))
        t, virtual = found
        alias = src.alias or src.parts[-1]
        if t.criterion:  # rows of every table in which one of the columns holds the value
            wanted = [self.constant(a) for a in src.args or []]
            if len(wanted) != 1:
                raise PlanProblem("PARSE_ERROR", f"{t.name} needs one value")
            found = [self.engine.catalog.tables[Catalog.normal(n.split("."))] for n, _ in t.criterion]
            parts = [x.df.where(F.col(c) == wanted[0]).select(F.lit(x.name).alias("table"), F.col(x.key).cast("string").alias("ref")) for x, (_, c) in zip(found, t.criterion)]
            df, b = self.bind(alias, reduce(DataFrame.unionByName, parts).distinct(), {"table": "table", "таблица": "table", "ref": "ref", "ссылка": "ref"}, {}, None, None)
            return df, [b]
        if virtual:
            df, logical = self.virtual(t, virtual, src.args or [])
        else:
            df, logical = t.df, t.columns
            if self.s.allowed and isinstance(t.restriction, str):
                df = self.filtered(t, Parser(re.sub(r"^\s*(?:ГДЕ|WHERE)\s", "", t.restriction, flags=re.I)).expr())
            elif self.s.allowed and t.restriction is not None:
                df = df.where(t.restriction)
        df, b = self.bind(alias, df, logical, t.refs, t.key if not virtual else None, t.presentation)
        if not virtual and t.key:
            self.owners.setdefault(t.name, b)
        internal = {c: i for i, c in b.shown.items()}
        b.composites = {k: [internal[c] for c in cs if c in internal] for k, cs in t.composites.items()}
        return df, [b]

    def join(self, j: ast.Join) -> tuple[DataFrame, list[Binding]]:
        left, lb = self.source(j.left)
        right, rb = self.source(j.right)
        held, self.bindings = self.bindings, self.bindings + lb + rb
        parts = _or_parts(j.on) if j.kind == "inner" else None
        if parts:  # a = b OR c = d would be a nested loop: a union of equi-joins, each without the rows of those before
            conds = [self.expr(p) for p in parts]
            df = None
            for i, c in enumerate(conds):
                rest = reduce(lambda a, x: a & ~F.coalesce(x, F.lit(False)), conds[:i], c)
                one = left.join(right, rest, "inner")
                df = one if df is None else df.unionByName(one)
        else:
            df = left.join(right, self.expr(j.on), j.kind)
        self.bindings = held
        return df, lb + rb

    def filtered(self, t: TableDef, cond: Any) -> DataFrame:
        """Rows of a table that a condition on its fields (and on what they refer to) lets through."""
        inner = SelectBuilder(self.qb, ast.Select([], []))
        inner.bindings = [Binding(t.name.lower(), dict(t.columns), {c: c for c in t.df.columns}, dict(t.refs), t.presentation, {k: list(v) for k, v in t.composites.items()})]
        inner.df = t.df
        for n in walk(cond):
            if isinstance(n, ast.Name):
                inner.resolve(n.parts)
        for c in conjuncts(cond):
            inner.apply(c)
        return inner.df.select(*t.df.columns)

    def virtual(self, t: TableDef, name: str, args: list) -> tuple[DataFrame, dict[str, str]]:
        """A virtual table's rows, and the names of its columns."""
        if name.startswith("?"):
            raise PlanProblem("UNKNOWN_VIRTUAL_TABLE", name[1:])
        args = list(args) + [None] * 6
        value = lambda a: None if a is None else self.constant(a)
        unit = lambda a: a.value if isinstance(a, ast.Lit) and isinstance(a.value, str) else None

        def rows(cond: Any) -> DataFrame:
            return t.df if cond is None else self.filtered(t, cond)

        names = dict(t.columns)
        if name in ("SLICELAST", "SLICEFIRST"):
            pick = vt.slice_last if name == "SLICELAST" else vt.slice_first
            return pick(rows(args[1]), t.dims, t.period, value(args[0]), t.ties), names
        if name == "BALANCE":
            df = vt.balance(rows(args[1]), t.dims, t.resources, t.period, t.receipt, value(args[0]))
        elif name == "TURNOVERS":
            df = vt.turnovers(rows(args[3]), t.dims, t.resources, t.period, t.receipt, value(args[0]), value(args[1]), unit(args[2]))
        elif name == "BALANCEANDTURNOVERS":
            df = vt.balance_and_turnovers(rows(args[4]), t.dims, t.resources, t.period, t.receipt, value(args[0]), value(args[1]), unit(args[2]))
        elif name == "DRCRTURNOVERS":
            df = vt.dr_cr_turnovers(rows(args[3]), t.debit, t.credit, t.dims, t.resources, t.period, value(args[0]), value(args[1]), unit(args[2]))
            names |= {"accountdr": t.debit, "счетдт": t.debit, "accountcr": t.credit, "счеткт": t.credit}
        elif name == "BOUNDARIES":
            return vt.boundaries(rows(args[0]), t.dims, t.period), names
        elif name == "EXTDIMENSIONS":
            return (df := vt.ext_dimensions(rows(args[0]), [t.period, *t.dims], [t.debit, t.credit])), names | {c.lower(): c for c in df.columns}
        elif name == "RECORDSWITHEXTDIMENSIONS":
            cond = args[2] if args[2] is not None else args[0]
            moved = rows(cond).withColumn("__record", F.monotonically_increasing_id())
            ext = vt.ext_dimensions(moved, ["__record"], [t.debit, t.credit]).withColumn("kind", F.concat(F.lit("ext_"), "kind"))
            wide = [f"ext_{t.debit}", f"ext_{t.credit}"]
            df = vt.records_with_ext_dimensions(moved, ext, ["__record"], wide).drop("__record")
            return df, names | {"extdimensiondr": wide[0], "субконтодт": wide[0], "extdimensioncr": wide[1], "субконтокт": wide[1]}
        elif name == "ACTUALACTIONPERIOD":
            df = vt.actual_action_period(rows(args[0]), t.dims, t.action[0], t.action[1], t.action[2])
            return df, {k: v for k, v in names.items() if v in df.columns} | {"actionperiodbegin": t.action[0], "периоддействияначало": t.action[0], "actionperiodend": t.action[1], "периоддействияконец": t.action[1]}
        elif name == "SCHEDULEDATA":
            plan, keys, day, hours = t.schedule
            df = vt.schedule_data(rows(args[0]), plan, keys, t.action[0], t.action[1], day, hours)
            return df, names | {"schedulevalue": hours, "значениеграфика": hours}
        elif name == "TASKBYPERFORMER":
            addressing, attributes, performer = t.addressing
            df = vt.tasks_by_performer(t.df, addressing, attributes, performer)
            if args[0] is not None:
                df = df.where(F.col(performer) == self.constant(args[0]))
            return df, names | {"performer": performer, "исполнитель": performer}
        else:
            raise PlanProblem("VIRTUAL_TABLE_NOT_AVAILABLE", name)
        for logical, physical in list(t.columns.items()):
            if physical in t.resources:
                for en, ru in SUFFIX.items():
                    if f"{physical}_{en}" in df.columns:
                        names[logical + (ru if re.search("[а-яё]", logical) else en)] = f"{physical}_{en}"
        return df, {k: v for k, v in names.items() if v in df.columns}

    def constant(self, e: Any) -> Column:
        return SelectBuilder(self.qb, ast.Select([], [])).expr(e)

    # -- names
    def lookup(self, parts: list[str]) -> tuple[Binding, list[str]] | None:
        head = parts[0].lower()
        for b in self.bindings:
            if b.alias == head and len(parts) > 1:
                return b, parts[1:]
        for b in self.bindings:
            if head in b.columns or head in b.composites:
                return b, parts
        return None

    def composite(self, e: Any) -> tuple[Binding, list[str], list[str]] | None:
        """(binding, internal columns, rest of the path) of a name that begins with a field of several types."""
        found = self.lookup(e.parts) if isinstance(e, ast.Name) else None
        if found and found[1][0].lower() in found[0].composites:
            b, path = found
            return b, b.composites[path[0].lower()], path[1:]
        return None

    def of_type(self, b: Binding, columns: list[str], table: list[str]) -> str | None:
        """The column that holds references to a table."""
        return next((c for c in columns if self.same_table(b.refs[c], table)), None)

    def same_table(self, name: str, parts: list[str]) -> bool:
        """Do a table's name and a path in any language mean the same table?"""
        tables = self.engine.catalog.tables
        one, other = tables.get(Catalog.normal(name.split("."))), tables.get(Catalog.normal(parts))
        return one is not None and one is other

    def resolve(self, parts: list[str]) -> str | None:
        """Internal column of a (chained) name; None if no source here has it."""
        found = self.lookup(parts)
        if not found:
            return None
        b, path = found
        if path[0].lower() in b.composites:  # the value, or a field that every type offers, from whichever type it is
            kinds, rest = b.composites[path[0].lower()], [p for p in path[1:] if p.lower() not in SELF]
            known = ("composite", repr(path) + b.alias)
            if known not in self.derefs:
                values = [F.col(c).cast("string") if not rest else F.col(self.follow(b, c, rest, parts)) for c in kinds]
                name = f"x{next(self.engine._ids)}"
                self.df = self.df.withColumn(name, F.coalesce(*values))
                self.derefs[known] = Binding(name, {}, {})
            return self.derefs[known].alias
        for i, p in enumerate(path):
            low = p.lower()
            if low in ("presentation", "представление") and low not in b.columns and b.presentation:
                return b.presentation
            col = b.columns.get(low)
            if col is None:
                if i == 0:
                    raise PlanProblem("FIELD_NOT_FOUND", ".".join(parts))
                raise PlanProblem("FIELD_CHAIN_INVALID", ".".join(parts))
            if i == len(path) - 1:
                return col
            if path[i + 1].lower() in SELF and i + 1 == len(path) - 1:
                return col
            b = self.dereference(b, col, parts)
        return None

    def follow(self, b: Binding, col: str, path: list[str], parts: list[str]) -> str:
        """Internal column at the end of a path that begins behind the reference in ``col``."""
        for i, p in enumerate(path):
            b = self.dereference(b, col, parts)
            col = b.presentation if p.lower() in ("presentation", "представление") else b.columns.get(p.lower())
            if col is None:
                raise PlanProblem("FIELD_CHAIN_INVALID", ".".join(parts))
        return col

    def dereference(self, b: Binding, col: str, parts: list[str]) -> Binding:
        """One left join per distinct prefix of a chain of references."""
        if col not in b.refs:
            raise PlanProblem("FIELD_CHAIN_INVALID", ".".join(parts))
        if (known := self.derefs.get((b.alias, col))) is not None:
            return known
        t = self.engine.catalog.tables[self.engine.catalog.normal(b.refs[col].split("."))]
        df, nb = self.bind(f"{b.alias}.{col}", t.df, t.columns, t.refs, t.key, t.presentation)
        self.df = self.df.join(df, F.col(col) == F.col(nb.columns[SELF[0]]), "left")
        self.derefs[(b.alias, col)] = nb
        return nb

    def nested(self, e: ast.Nested) -> str:
        """Rows of a tabular section as an array of structures beside the row they belong to; one join on the owner's key."""
        known = self.derefs.get(("nested", repr(e)))
        if known is not None:
            return known.columns["rows"]
        alias, section = (e.parts[0].lower(), e.parts[-1]) if len(e.parts) > 1 else (None, e.parts[-1])
        for src_name, b in self.owners.items():
            if alias in (None, b.alias) and (found := self.engine.catalog.find([*src_name.split("."), section])) and found[1] is None:
                t = found[0]
                link = next((c for c, target in t.refs.items() if Catalog.normal(target.split(".")) == Catalog.normal(src_name.split("."))), None)
                if link is None:
                    continue
                cols = []
                for f in e.fields:
                    if not isinstance(f.expr, ast.Name) or f.expr.parts[-1].lower() not in t.columns:
                        raise PlanProblem("FIELD_NOT_FOUND", repr(f.expr))
                    cols.append(F.col(t.columns[f.expr.parts[-1].lower()]).alias(f.alias or f.expr.parts[-1]))
                rows = t.df.groupBy(F.col(link).alias("owner")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("rows"))  # as many as one document has
                df, nb = self.bind(f"nested{len(self.derefs)}", rows, {"owner": "owner", "rows": "rows"}, {}, None, None)
                self.df = self.df.join(df, F.col(b.columns[SELF[0]]) == F.col(nb.columns["owner"]), "left")
                self.derefs[("nested", repr(e))] = nb
                return nb.columns["rows"]
        raise PlanProblem("FIELD_CHAIN_INVALID", ".".join(e.parts))

    def canonical(self, e: Any) -> str:
        """A text that is equal for equal expressions, whatever way their columns are named."""
        if isinstance(e, ast.Name):
            return self.resolve(e.parts) or repr(e.parts)
        if is_dataclass(e) and not isinstance(e, ast.Query):
            return type(e).__name__ + "(" + ",".join(self.canonical(getattr(e, f.name)) for f in fields(e)) + ")"
        if isinstance(e, (list, tuple)):
            return "[" + ",".join(map(self.canonical, e)) + "]"
        return repr(e)

    # -- conditions
    def apply(self, cond: Any) -> None:
        """Filter by one conjunct; membership in a subquery or hierarchy becomes a semi or anti join."""
        negated = isinstance(cond, ast.Unary) and cond.op == "NOT"
        inner = cond.arg if negated else cond
        if isinstance(inner, ast.In) and (inner.query is not None or inner.hierarchy):
            right = self.members(inner)
            n = next(self.engine._ids)
            right = right.toDF(*(f"m{n}_{i}" for i in range(len(right.columns))))
            if negated:
                self.not_in([self.expr(a) for a in inner.args], right)
            else:
                on = reduce(lambda a, b: a & b, [self.expr(a) == F.col(c) for a, c in zip(inner.args, right.columns)])
                self.df = self.df.join(right, on, "left_semi")
            return
        self.df = self.df.where(self.expr(cond))

    def not_in(self, args: list[Column], right: DataFrame) -> None:
        """NOT IN, which is never true where a null could be the missing partner.

        Rows without a null take part in an anti join on equality; whether the subquery holds rows with nulls, or any row
        at all, are single values.  With several columns the rows with nulls are told apart by which columns are null,
        and each kind is compared on the columns that are not: equi-joins only, nothing is broadcast unseen.
        """
        n = len(args)
        kinds = list(itertools.product((False, True), repeat=n))  # which columns are null
        names = [f"__arg{i}" for i in range(n)]
        left = self.df.withColumns(dict(zip(names, args)))

        def of_kind(columns: list[str], kind: tuple) -> Column:
            return reduce(lambda a, b: a & b, [F.col(c).isNull() if null else F.col(c).isNotNull() for c, null in zip(columns, kind)])

        parts = []
        for mine in kinds:
            rows = left.where(of_kind(names, mine))
            for theirs in kinds:
                both = [i for i in range(n) if not mine[i] and not theirs[i]]
                some = right.where(of_kind(right.columns, theirs))
                if both:
                    rows = rows.join(some.select(*(right.columns[i] for i in both)).distinct(), reduce(lambda a, b: a & b, [F.col(names[i]) == F.col(right.columns[i]) for i in both]), "left_anti")
                else:  # every row could be the partner
                    rows = rows.where(some.select(F.count(F.lit(1)).alias("n")).scalar() == 0)
            parts.append(rows)
        self.df = reduce(DataFrame.unionByName, parts).drop(*names)

    def members(self, e: ast.In) -> DataFrame:
        if e.query is not None:
            df = QueryBuilder(self.engine, self.params, self.temps, self).query(e.query)
        else:
            values = [x for i in e.items for x in self.values(i)]
            df = self.engine.spark.createDataFrame([(v,) for v in values], "key string" if any(isinstance(v, str) for v in values) else "key bigint")
        if not e.hierarchy:
            return df
        t = self.hierarchical(e.args[0])
        return hierarchy.below(t.df, t.key, t.parent, df.toDF("key"))

    def hierarchical(self, e: Any) -> TableDef:
        """The table with parents that a column refers to."""
        if isinstance(e, ast.Name):
            col = self.resolve(e.parts)
            for b in [*self.bindings, *self.derefs.values()]:
                target = b.refs.get(col)
                for t in self.engine.catalog.tables.values():
                    own = b.shown.get(col) == t.key and col in b.columns.values() and set(b.shown.values()) == set(t.df.columns)
                    if t.parent and (target and self.engine.catalog.normal(target.split(".")) == self.engine.catalog.normal(t.name.split(".")) or own):
                        return t
        raise PlanProblem("FIELD_CHAIN_INVALID", "IN HIERARCHY needs a reference to a table with parents")

    def referred_table(self, output: str) -> TableDef:
        """The table with parents that an output column refers to."""
        out_fields = [x for f in self.s.fields for x in self.expand(f)]
        expr = next((f.expr for f, n in zip(out_fields, self.output_names(out_fields)) if n == output), None)
        return self.hierarchical(expr)

    def values(self, e: Any) -> list:
        if isinstance(e, ast.Param):
            v = self.params[e.name]
            return list(v) if isinstance(v, (list, tuple, set)) else [v]
        if isinstance(e, ast.Lit):
            return [e.value]
        raise PlanProblem("PARSE_ERROR", "a list of values holds literals and parameters")

    # -- expressions
    def expr(self, e: Any) -> Column:
        if self.replaced and (done := self.replaced.get(self.canonical(e))) is not None:
            return done
        match e:
            case ast.Lit():
                return F.lit(e.value)
            case ast.Param():
                if e.name not in self.params:
                    raise PlanProblem("PARAMETER_NOT_SET", e.name)
                return F.lit(self.params[e.name])
            case ast.Name():
                col = self.resolve(e.parts)
                if col is not None:
                    return F.col(col)
                if self.qb.outer is not None:
                    return self.qb.outer.expr(e).outer() if not self.qb.outer.replaced else self.qb.outer.expr(e)
                raise PlanProblem("FIELD_NOT_FOUND", ".".join(e.parts))
            case ast.Binary():
                return self.binary(e)
            case ast.Unary():
                return ~self.expr(e.arg) if e.op == "NOT" else -self.expr(e.arg)
            case ast.Case():
                base = None if e.base is None else self.expr(e.base)
                out = None
                for cond, then in e.whens:
                    test = self.expr(cond) if base is None else base == self.expr(cond)
                    out = F.when(test, self.expr(then)) if out is None else out.when(test, self.expr(then))
                return out if e.otherwise is None else out.otherwise(self.expr(e.otherwise))
            case ast.Cast():
                return self.cast(e)
            case ast.Between():
                return self.expr(e.arg).between(self.expr(e.low), self.expr(e.high))
            case ast.Like():
                return self.like(e)
            case ast.IsNull():
                return self.expr(e.arg).isNull()
            case ast.In():
                if e.query is None and not e.hierarchy:
                    items = [v for i in e.items for v in (self.values(i) if isinstance(i, (ast.Param, ast.Lit)) else [self.expr(i)])]
                    return self.expr(e.args[0]).isin(items) if items else F.lit(False)
                right = self.members(e)
                sub = right.where(reduce(lambda a, b: a & b, [self.expr(a).outer() == F.col(c) for a, c in zip(e.args, right.columns)]))
                return sub.exists()
            case ast.Refs() if self.composite(e.arg):
                b, columns, _ = self.composite(e.arg)
                col = self.of_type(b, columns, e.table)
                return F.col(col).isNotNull() if col else F.lit(False)
            case ast.Refs():
                col = self.resolve(e.arg.parts) if isinstance(e.arg, ast.Name) else None
                owner = next((b.refs.get(col) for b in [*self.bindings, *self.derefs.values()] if col in b.refs), None)
                same = owner is not None and self.same_table(owner, e.table)
                return self.expr(e.arg).isNotNull() if same else F.lit(False)
            case ast.Scalar():
                return QueryBuilder(self.engine, self.params, self.temps, self).query(e.query).scalar()
            case ast.Call():
                return self.call(e)
            case ast.Nested():
                return F.col(self.nested(e))
        raise PlanProblem("PARSE_ERROR", f"cannot use {type(e).__name__} here")

    def binary(self, e: ast.Binary) -> Column:
        a, b = self.expr(e.left), self.expr(e.right)
        match e.op:
            case "AND":
                return a & b
            case "OR":
                return a | b
            case "=":
                return a == b
            case "<>":
                return a != b
            case "<":
                return a < b
            case "<=":
                return a <= b
            case ">":
                return a > b
            case ">=":
                return a >= b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return a / b
        return F.concat(a, b) if self.textual(e.left) or self.textual(e.right) else a + b

    def textual(self, e: Any) -> bool:
        """Is the expression a string?  Decides between addition and concatenation."""
        if isinstance(e, ast.Lit):
            return isinstance(e.value, str)
        if isinstance(e, ast.Param):
            return isinstance(self.params.get(e.name), str)
        if isinstance(e, ast.Name) and self.df is not None and (col := self.resolve(e.parts)) in self.df.columns:
            return self.df.schema[col].dataType.typeName() == "string"
        if isinstance(e, ast.Binary) and e.op == "+":
            return self.textual(e.left) or self.textual(e.right)
        if isinstance(e, ast.Call):
            return e.func in ("SUBSTRING", "LOWER", "UPPER", "TRIMALL", "TRIML", "TRIMR", "LEFT", "RIGHT", "STRREPLACE", "STRING", "PRESENTATION", "REFPRESENTATION")
        return isinstance(e, ast.Cast) and e.kind.upper() in ("STRING", "СТРОКА")

    def like(self, e: ast.Like) -> Column:
        pattern = e.pattern.value if isinstance(e.pattern, ast.Lit) else self.params.get(e.pattern.name) if isinstance(e.pattern, ast.Param) else None
        if pattern is None:
            return self.expr(e.arg).like(self.expr(e.pattern))
        if "[" in pattern:  # character classes exist in the language but not in LIKE
            return self.expr(e.arg).rlike(like_regex(pattern, e.escape))
        return F.like(self.expr(e.arg), F.lit(pattern), F.lit(e.escape)) if e.escape else self.expr(e.arg).like(pattern)

    def cast(self, e: ast.Cast) -> Column:
        kind = e.kind.upper()
        if "." in kind and (several := self.composite(e.arg)):
            b, columns, _ = several
            col = self.of_type(b, columns, kind.split("."))
            if col is None:
                return F.lit(None)
            return F.col(self.follow(b, col, e.path, e.arg.parts) if e.path else col)
        if "." in kind or KINDS.get(kind.split(".")[0]):
            if isinstance(e.arg, ast.Name) and e.path:
                return self.expr(ast.Name([*e.arg.parts, *e.path]))
            return self.expr(e.arg)
        a = self.expr(e.arg)
        if kind in ("NUMBER", "ЧИСЛО"):
            length, scale = (e.params + [10, 0])[:2] if e.params else (38, 10)
            return a.cast(f"decimal({length},{scale if len(e.params) > 1 or not e.params else 0})")
        if kind in ("STRING", "СТРОКА"):
            return F.substring(a.cast("string"), 1, e.params[0]) if e.params else a.cast("string")
        if kind in ("BOOLEAN", "БУЛЕВО"):
            return a.cast("boolean")
        if kind in ("DATE", "ДАТА"):
            return a.cast("timestamp_ntz")
        raise PlanProblem("PARSE_ERROR", f"unknown type {e.kind}")

    def call(self, e: ast.Call) -> Column:
        f = e.func
        if f in AGGREGATES:
            if f == "COUNT":
                if isinstance(e.args[0], ast.Star):
                    return F.count(F.lit(1))
                return F.count_distinct(self.expr(e.args[0])) if e.distinct else F.count(self.expr(e.args[0]))
            if f == "SUM" and e.distinct:
                return F.sum_distinct(self.expr(e.args[0]))
            return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[f](self.expr(e.args[0]))
        if f == "DATETIME":
            parts = [self.expr(a) for a in e.args] + [F.lit(0)] * (6 - len(e.args))
            return F.make_timestamp_ntz(*parts)
        if f in ("BEGINOFPERIOD", "ENDOFPERIOD"):
            unit = e.args[1].value if len(e.args) > 1 else "DAY"
            return (scalar.begin_of_period if f == "BEGINOFPERIOD" else scalar.end_of_period)(self.expr(e.args[0]), unit)
        if f == "DATEADD":
            return scalar.date_add(self.expr(e.args[0]), e.args[1].value, self.expr(e.args[2]))
        if f == "DATEDIFF":
            return scalar.date_diff(self.expr(e.args[0]), self.expr(e.args[1]), e.args[2].value)
        if f == "ROUND":
            scale = e.args[1].value if len(e.args) > 1 else 0
            return F.round(self.expr(e.args[0]), scale)
        if f in ("PRESENTATION", "REFPRESENTATION"):
            arg = e.args[0]
            if isinstance(arg, ast.Name) and (col := self.resolve(arg.parts)):
                b = self.lookup(arg.parts)[0]
                if col in b.refs:
                    return F.col(self.dereference(b, col, arg.parts).presentation)
                if b.presentation and col == b.columns.get(SELF[0]):
                    return F.col(b.presentation)
            return self.expr(arg).cast("string")
        if f == "TYPE":
            return F.lit(Catalog.normal(e.args[0].value.split(".")))
        if f == "VALUETYPE" and (several := self.composite(e.args[0])):
            b, columns, _ = several
            return F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(Catalog.normal(b.refs[c].split(".")))) for c in columns))
        if f == "VALUETYPE":
            arg = e.args[0]
            col = self.resolve(arg.parts) if isinstance(arg, ast.Name) else None
            owner = next((b.refs[col] for b in [*self.bindings, *self.derefs.values()] if col in b.refs), None)
            return F.lit(Catalog.normal(owner.split("."))) if owner else F.upper(F.typeof(self.expr(arg)))
        if f == "VALUE":
            parts = e.args[0].value.split(".")
            if parts[-1].lower() in ("emptyref", "пустаяссылка"):
                return F.lit(None)
            found = self.engine.catalog.find(parts[:-1])
            if not found:
                raise PlanProblem("TABLE_NOT_FOUND", e.args[0].value)
            t = found[0]
            return t.df.where(F.col(t.presentation) == parts[-1]).agg(F.min(t.key)).scalar()
        if f == "EMPTYTABLE":
            return F.array().cast("array<struct<" + ",".join(f"`{a.parts[-1]}`:string" for a in e.args) + ">>")
        if f == "GROUPEDBY":
            return 1 - F.grouping(self.expr(e.args[0]))
        if f in scalar.SIMPLE:
            return scalar.SIMPLE[f]([self.expr(a) for a in e.args])
        raise PlanProblem("PARSE_ERROR", f"unknown function {f}")

    def presentation_of(self, e: Any) -> Column | None:
        """What a reference is shown as; None for anything else."""
        col = self.resolve(e.parts) if isinstance(e, ast.Name) else None
        for b in [*self.bindings, *self.derefs.values()]:
            if col is not None and col in b.refs:
                shown = self.dereference(b, col, e.parts).presentation
                return F.col(shown) if shown else None
            if col is not None and b.presentation and col == b.columns.get(SELF[0]):
                return F.col(b.presentation)
        return None

    # -- the whole
    def build(self, order: list, autoorder: bool) -> DataFrame:
        s = self.s
        if not s.sources:
            self.df = self.engine.spark.range(1).select()
        for src in s.sources:
            df, bs = self.source(src)
            self.df = df if self.df is None else self.df.crossJoin(df)
            self.bindings += bs
        out_fields = [x for f in s.fields for x in self.expand(f)]
        if s.where is not None or order or out_fields:
            for n in walk([s.where, [f.expr for f in out_fields], s.group, s.sets, s.having, [o[0] for o in order]]):
                if isinstance(n, ast.Name) and self.lookup(n.parts):  # joins for chains of references come before all else
                    alias_only = len(n.parts) == 1 and any(f.alias and f.alias.lower() == n.parts[0].lower() for f in out_fields)
                    if not alias_only or n.parts[0].lower() in {c for b in self.bindings for c in b.columns}:
                        self.resolve(n.parts)
                if isinstance(n, ast.Nested):
                    self.nested(n)
                if isinstance(n, ast.Cast) and n.path and isinstance(n.arg, ast.Name):
                    if self.composite(n.arg):
                        self.cast(n)
                    else:
                        self.resolve([*n.arg.parts, *n.path])
                if isinstance(n, ast.Call) and n.func in ("PRESENTATION", "REFPRESENTATION"):
                    self.call(n)
        if s.where is not None:
            for c in conjuncts(s.where):
                self.apply(c)
        calls = [n for n in walk([[f.expr for f in out_fields], s.having, [o[0] for o in order]]) if isinstance(n, ast.Call) and n.func in (*AGGREGATES, "GROUPEDBY")]
        if s.group or s.sets is not None or any(c.func in AGGREGATES for c in calls):
            self.aggregate(calls)
        if s.having is not None:
            self.df = self.df.where(self.expr(s.having))
        names = self.output_names(out_fields)
        columns = []
        for f, n in zip(out_fields, names):
            if isinstance(f.expr, ast.Call) and f.expr.func == "RECORDAUTONUMBER":
                columns.append(F.lit(None).cast("bigint").alias(n))
            else:
                columns.append(self.expr(f.expr).alias(n))
        keys = []
        hidden = []
        aliases = {n.lower(): n for n in names}
        for i, (e, desc, hier) in enumerate(order):
            name = aliases.get(e.parts[-1].lower()) if isinstance(e, ast.Name) and (len(e.parts) == 1 or not s.distinct and not self.replaced and False) else None
            if isinstance(e, ast.Lit) and isinstance(e.value, int):
                name = names[e.value - 1]
            if name is None:
                name = f"__order{i}"
                hidden.append(self.expr(e).alias(name))
            keys.append((name, desc, hier, e))
        if s.distinct and hidden:
            raise PlanProblem("PARSE_ERROR", "with DISTINCT only selected fields can be ordered by")
        if autoorder and not keys:
            for f, n in zip(out_fields, names):
                shown = self.presentation_of(f.expr) if not s.distinct and not self.replaced else None
                if shown is not None:
                    hidden.append(shown.alias(f"__shown_{n}"))
                keys.append((n if shown is None else f"__shown_{n}", False, False, None))
        df = self.df.select(*columns, *hidden)
        if s.distinct:
            df = df.distinct()
        if keys:
            sort = []
            for name, desc, hier, e in keys:
                if hier:
                    t = self.hierarchical(e if e.parts[-1].lower() not in aliases else next(f.expr for f, n in zip(out_fields, names) if n == name))
                    p = hierarchy.paths(t.df, self.engine.closure(t), t.key, t.presentation).select(F.col("key").alias(name), F.col("path").alias(f"__path_{name}"))
                    df = df.join(p, name, "left")
                    name = f"__path_{name}"
                sort.append(F.col(f"`{name}`").desc_nulls_last() if desc else F.col(f"`{name}`").asc_nulls_first())
            df = df.orderBy(*sort)
        if s.top is not None:
            df = df.limit(s.top)
        numbers = [n for f, n in zip(out_fields, names) if isinstance(f.expr, ast.Call) and f.expr.func == "RECORDAUTONUMBER"]
        if numbers:
            df = number_rows(df, numbers, sort if keys else [], [n for n in names if n not in numbers])
        return df.select(*(F.col(f"`{n}`") for n in names))

    def aggregate(self, calls: list) -> None:
        s = self.s
        groups = s.group if s.sets is None else [g for st in s.sets for g in st]
        unique: dict[str, tuple[str, Column]] = {}
        for g in groups:
            unique.setdefault(self.canonical(g), (f"g{len(unique)}", self.expr(g)))
        aggs: dict[str, tuple[str, Column]] = {}
        for c in calls:
            if c.func == "GROUPEDBY":
                aggs.setdefault(self.canonical(c), (f"a{len(aggs)}", 1 - F.grouping(F.col(unique[self.canonical(c.args[0])][0]))))
            else:
                aggs.setdefault(self.canonical(c), (f"a{len(aggs)}", self.expr(c)))
        staged = self.df.withColumns({n: c for n, c in unique.values()}) if unique else self.df
        columns = [a.alias(n) for n, a in aggs.values()] or [F.count(F.lit(1)).alias("__n")]
        if s.sets is not None:
            sets = [[F.col(unique[self.canonical(g)][0]) for g in st] for st in s.sets]
            out = staged.groupingSets(sets, *(n for n, _ in unique.values())).agg(*columns)
        elif unique:
            out = staged.groupBy(*(n for n, _ in unique.values())).agg(*columns)
        else:  # stays lazy, so that a correlated subquery may refer to columns outside
            out = staged.select(*columns)
        self.df = out
        self.replaced = {k: F.col(n) for k, (n, _) in (unique | aggs).items()}

    def expand(self, f: ast.Field) -> list[ast.Field]:
        if not isinstance(f.expr, ast.Star):
            return [f]
        out = []
        for b in self.bindings:
            if f.expr.table is None or b.alias == f.expr.table.lower():
                shown = {v: k for k, v in b.shown.items()}
                out += [ast.Field(ast.Name([b.alias, name.lower()]), name) for name in shown]
        return out

    def output_names(self, out_fields: list[ast.Field]) -> list[str]:
        names: list[str] = []
        for i, f in enumerate(out_fields):
            name = f.alias or (f.expr.parts[-1] if isinstance(f.expr, ast.Name) else f"Field{i + 1}")
            while name in names:
                name += "1"
            names.append(name)
        return names


def _or_parts(e: Any) -> list | None:
    """Disjuncts of an OR of equalities; None for any other condition."""
    if not (isinstance(e, ast.Binary) and e.op == "OR"):
        return None
    out: list = []

    def collect(x: Any) -> bool:
        if isinstance(x, ast.Binary) and x.op == "OR":
            return collect(x.left) and collect(x.right)
        out.append(x)
        return all(isinstance(c, ast.Binary) and c.op == "=" and isinstance(c.left, ast.Name) and isinstance(c.right, ast.Name) for c in conjuncts(x))

    return out if collect(e) else None


def like_regex(pattern: str, escape: str | None) -> str:
    """A LIKE pattern with character classes as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 1
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            out.append(pattern[i : j + 1])
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def number_rows(df: DataFrame, names: list[str], sort: list[Column], rest: list[str]) -> DataFrame:
    """Consecutive numbers from 0 in the columns ``names``, in the order ``sort`` and then by the columns ``rest``.

    Rows are range-partitioned and sorted, and so placed they are stored, for a second run might place them otherwise; the
    number of rows before each partition (one row per partition) is added to the position within it.
    """
    order = [*sort, *(F.col(f"`{c}`").asc_nulls_first() for c in rest)]
    bare = df.drop(*names)
    placed = checkpointed(bare.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mid", F.monotonically_increasing_id()) if order else bare.withColumn("__mid", F.monotonically_increasing_id()))
    split = placed.withColumn("__part", F.shiftright("__mid", 33)).withColumn("__pos", F.col("__mid").bitwiseAND((1 << 33) - 1))
    sizes = {r["__part"]: r.n for r in split.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    numbered = split.join(F.broadcast(offsets), "__part")
    number = (F.col("__before") + F.col("__pos")).cast("bigint")
    out = numbered.select(*(number.alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))
    return out.orderBy(F.col(f"`{names[0]}`")) if sort else out


def explain(text: str) -> dict:
    """What a batch reads, returns and does: tables, fields, joins, filters, grouping, aggregates, order, parameters."""
    out = {"tables": [], "virtual_tables": [], "fields": [], "joins": [], "aggregates": [], "grouping": 0, "order": 0, "parameters": [], "temp_tables": [], "statements": 0}
    for q in parse(text):
        out["statements"] += 1
        if isinstance(q, ast.Drop):
            continue
        out["order"] += len(q.order)
        for _, s in q.branches:
            if s.into:
                out["temp_tables"].append(s.into)
            out["grouping"] += len(s.group)
            out["fields"] += [f.alias or (f.expr.parts[-1] if isinstance(f.expr, ast.Name) else type(f.expr).__name__) for f in s.fields]
            for n in walk([s, q.order, q.totals, q.totals_by]):
                if isinstance(n, ast.Table):
                    out["tables"].append(".".join(n.parts))
                    if len(n.parts) == 3 and n.parts[2].upper() in VIRTUAL:
                        out["virtual_tables"].append(n.parts[2])
                elif isinstance(n, ast.Join):
                    out["joins"].append(n.kind)
                elif isinstance(n, ast.Call) and n.func in AGGREGATES:
                    out["aggregates"].append(n.func)
                elif isinstance(n, ast.Param):
                    out["parameters"].append(n.name)
    return {k: list(dict.fromkeys(v)) if isinstance(v, list) else v for k, v in out.items()}
