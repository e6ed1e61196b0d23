"""Deeply nested records into related flat tables.

Every level becomes a table of its own.  A row carries the key of its record, the ids of its ancestors and its own index,
so children join back to their parents without a lookup by name.  The projection is one chain of higher-order functions
(``transform`` attaches ancestor keys, ``flatten`` joins the arrays) with one ``inline`` per target table; there is no
shuffle and no Python.

JSON text may come as a list of objects, one object, objects by kind (``{"Attribute": [...]}``), objects by name
(``{"Price": {...}}``), or any of these encoded a second time as a JSON string.  Null, blank and damaged texts, ``null``
and empty containers give no rows; an element without a name gives a row with a null name in the flat tables (and none in
the list of paths).  Repeated elements stay repeated, told apart by their index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _get(v: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """'ARRAY', 'OBJECT', 'STRING', ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _entry(name: Column, body: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), body.alias("body"))


def _elements(v: Column) -> Column:
    return F.transform(
        _get(v, "array<variant>"),
        lambda x: _entry(F.when(_kind(x) == "OBJECT", _get(x, "string", "$.name")).otherwise(F.lit(None)), x),
    )


def _no_entries(v: Column) -> Column:
    return F.filter(F.array(_entry(F.lit(None), v)), lambda _: F.lit(False))


def _named(v: Column) -> Column:
    """Is the object itself one element (it has a scalar ``name`` or a ``data_type``)?"""
    name = _get(v, "variant", "$.name")
    return (name.isNotNull() & ~_kind(name).isin("OBJECT", "ARRAY")) | _get(v, "variant", "$.data_type").isNotNull()


def _members(v: Column) -> Column:
    """Members of an object: a list of objects holds elements (keyed by kind), anything else is one element keyed by name."""
    return F.flatten(
        F.transform(
            F.map_entries(_get(v, "map<string,variant>")),
            lambda e: F.when(
                (_kind(e["value"]) == "ARRAY")
                & (F.coalesce(_kind(F.try_variant_get(e["value"], "$[0]", "variant")), F.lit("OBJECT")) == "OBJECT"),
                _elements(e["value"]),
            ).otherwise(
                F.array(
                    _entry(
                        F.coalesce(F.when(_kind(e["value"]) == "OBJECT", _get(e["value"], "string", "$.name")), e["key"]),
                        e["value"],
                    )
                )
            ),
        )
    )


def entries(v: Column) -> Column:
    """``array<struct<name, body variant>>`` of a container in any of the accepted shapes; empty for everything else."""
    kind = _kind(v)
    return F.coalesce(
        F.when(kind == "ARRAY", _elements(v))
        .when((kind == "OBJECT") & _named(v), F.array(_entry(_get(v, "string", "$.name"), v)))
        .when(kind == "OBJECT", _members(v)),
        _no_entries(v),
    )


def data_type(body: Column) -> Column:
    """The element's type expression as text: of ``data_type`` if it is an object, else the body itself."""
    return F.when(_kind(body) == "OBJECT", F.to_json(_get(body, "variant", "$.data_type"))).otherwise(F.to_json(body))


def parsed_json(text: Column) -> Column:
    """The text as a variant, with one level of double encoding undone; null if it does not parse."""
    v = F.try_parse_json(text)
    return F.when(_kind(v) == "STRING", F.try_parse_json(_get(v, "string"))).otherwise(v)


def field_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` with ``tree``: array of fields (idx, name, kind, data_type, attrs: array of (idx, name, data_type))."""
    staged = df.select(F.col(key).alias("rec_id"), parsed_json(F.col(text)).alias("v")).where("v IS NOT NULL")

    def attribute(e: Column, i: Column) -> Column:
        return F.struct(i.alias("idx"), e["name"].alias("name"), data_type(e["body"]).alias("data_type"))

    def field(e: Column, i: Column) -> Column:
        return F.struct(
            i.alias("idx"),
            e["name"].alias("name"),
            F.when(_kind(e["body"]) == "OBJECT", _get(e["body"], "string", "$.type")).alias("kind"),
            data_type(e["body"]).alias("data_type"),
            F.transform(
                F.when(_kind(e["body"]) == "OBJECT", entries(_get(e["body"], "variant", "$.attributes"))).otherwise(_no_entries(e["body"])),
                attribute,
            ).alias("attrs"),
        )

    return staged.select("rec_id", F.transform(entries(F.col("v")), field).alias("tree"))


def field_rows() -> dict[str, Column]:
    """Rows of the tables ``fields`` and ``attributes`` as arrays over ``tree``, with the ids of their ancestors."""
    return {
        "fields": F.transform("tree", lambda f: F.struct(f["idx"].alias("field_idx"), f["name"].alias("name"), f["kind"].alias("kind"), f["data_type"].alias("data_type"))),
        "attributes": F.flatten(
            F.transform(
                "tree",
                lambda f: F.transform(
                    f["attrs"],
                    lambda a: F.struct(f["idx"].alias("field_idx"), a["idx"].alias("attr_idx"), f["name"].alias("field_name"), a["name"].alias("name"), a["data_type"].alias("data_type")),
                ),
            )
        ),
    }


def flatten_fields(df: DataFrame, key: str, text: str) -> dict[str, DataFrame]:
    """Tables ``fields`` (rec_id, field_idx, name, kind, data_type) and ``attributes`` (rec_id, field_idx, attr_idx,
    field_name, name, data_type); (rec_id, field_idx) is the parent link."""
    tree = field_tree(df, key, text)
    return {k: tree.select("rec_id", F.inline(v)) for k, v in field_rows().items()}


def _emit_paths(df: DataFrame, *levels: Column) -> DataFrame:
    """rec_id, path: the different paths of a record's flat rows, all levels in one ``inline``."""
    paths = F.array_distinct(F.filter(F.concat(*levels), lambda p: p.isNotNull()))
    return df.select("rec_id", F.inline(F.transform(paths, lambda p: F.struct(p.alias("path")))))


def field_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """rec_id, path of the rows of ``fields`` and ``attributes`` (``field/attribute``)."""
    rows = field_rows()
    return _emit_paths(field_tree(df, key, text), F.transform(rows["fields"], lambda r: r["name"]), F.transform(rows["attributes"], lambda r: F.concat(r["field_name"], F.lit("/"), r["name"])))


def _indexed(xs: Column, has: str | None = None) -> Column:
    """Elements with their index, without nulls (and without those whose array ``has`` is null)."""
    pairs = F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() if has is None else p["x"].isNotNull() & p["x"][has].isNotNull())


def borrowed_rows(scalars: list[str]) -> dict[str, Column]:
    """Rows of the tables ``objects``, ``children`` and ``attributes`` as arrays over ``o``, with the ids of their ancestors."""
    objects = F.transform(_indexed(F.col("o")), lambda o: F.struct(o["i"].alias("object_idx"), *(o["x"][n].alias(n) for n in scalars)))
    children = F.flatten(
        F.transform(
            _indexed(F.col("o"), "child_objects"),
            lambda o: F.transform(
                _indexed(o["x"]["child_objects"]),
                lambda c: F.struct(
                    o["i"].alias("object_idx"), c["i"].alias("child_idx"), o["x"]["object_ref"].alias("object_ref"), c["x"]["kind"].alias("kind"), c["x"]["name"].alias("name")
                ),
            ),
        )
    )
    attributes = F.flatten(
        F.flatten(
            F.transform(
                _indexed(F.col("o"), "child_objects"),
                lambda o: F.transform(
                    _indexed(o["x"]["child_objects"], "attributes"),
                    lambda c: F.transform(
                        _indexed(c["x"]["attributes"]),
                        lambda a: F.struct(
                            o["i"].alias("object_idx"),
                            c["i"].alias("child_idx"),
                            a["i"].alias("attr_idx"),
                            o["x"]["object_ref"].alias("object_ref"),
                            c["x"]["name"].alias("child_name"),
                            a["x"]["name"].alias("name"),
                            a["x"]["kind"].alias("kind"),
                        ),
                    ),
                ),
            )
        )
    )
    return {"objects": objects, "children": children, "attributes": attributes}


def flatten_borrowed(df: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Tables ``objects``, ``children`` and ``attributes`` of an array of borrowed objects.

    (rec_id, object_idx) links children to objects, (rec_id, object_idx, child_idx) attributes to children.  Null
    elements at any level give no row but keep their place in the count of indices.
    """
    base, rows = _borrowed(df, key, column)
    return {k: base.select("rec_id", F.inline(v)) for k, v in rows.items()}


def _borrowed(df: DataFrame, key: str, column: str) -> tuple[DataFrame, dict[str, Column]]:
    scalars = [f.name for f in df.schema[column].dataType.elementType.fields if f.name != "child_objects"]
    return df.select(F.col(key).alias("rec_id"), F.col(column).alias("o")).where("o IS NOT NULL"), borrowed_rows(scalars)


def borrowed_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """rec_id, path of the rows of ``objects``, ``children`` (``object/child``) and ``attributes``
    (``object/child/attribute``)."""
    base, rows = _borrowed(df, key, column)
    return _emit_paths(
        base,
        F.transform(rows["objects"], lambda r: r["object_ref"]),
        F.transform(rows["children"], lambda r: F.concat(r["object_ref"], F.lit("/"), r["name"])),
        F.transform(rows["attributes"], lambda r: F.concat(r["object_ref"], F.lit("/"), r["child_name"], F.lit("/"), r["name"])),
    )
