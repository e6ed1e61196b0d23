"""Queries of the general training-data problems (2, 3, 4 and 6), with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import nested, packed, references, snapshots
from ledgerloom.session import spread, table

METHOD_TEXTS = "title name_ru name_en category version_since version_deprecated syntax returns description availability example".split()


def _p2(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "config_objects")
    refs = references.config_references(table(spark, d, "query_tables"), objects, table(spark, d, "cfe_diffs"))
    return references.orphans(refs, references.lives(objects), references.deliveries(objects))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).where("depth = 0").select("src", "rec_id", "ref").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_p2(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = packed.packed_values(spread(table(spark, d, "methods").select("id", "availability")), "availability", "id").select(F.lit("methods").alias("src"), F.col("id").alias("rec_id"), "pos", "item")
    # methods.id is unique; violations are delivered again with the same id
    v = packed.packed_values(spread(table(spark, d, "context_violations").select("violation_id", "available_in")), "available_in", "violation_id")
    v = v.select(F.lit("context_violations").alias("src"), F.col("violation_id").alias("rec_id"), "pos", "item").distinct()
    return m.unionByName(v)


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """Every packed value of context_violations with its error flag ('malformed_quote', 'unbalanced_parenthesis' or null)."""
    return packed.packed_values(spread(table(spark, d, "context_violations").select("violation_id", "available_in", "loaded_at")), "available_in", "violation_id", "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    o = nested.field_paths(table(spark, d, "config_objects"), "obj_id", "fields").withColumn("src", F.lit("config_objects"))
    c = nested.borrowed_paths(table(spark, d, "cfe_diffs"), "diff_id", "borrowed_objects").withColumn("src", F.lit("cfe_diffs"))
    return o.unionByName(c).select("src", "rec_id", "path")


def p4_fields(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of fields (their data types as JSON)."""
    return nested.flatten_fields(table(spark, d, "config_objects"), "obj_id", "fields")["fields"]


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of borrowed objects."""
    return nested.flatten_borrowed(table(spark, d, "cfe_diffs"), "diff_id", "borrowed_objects")["objects"]


def p4_children(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the borrowed objects' children."""
    return nested.flatten_borrowed(table(spark, d, "cfe_diffs"), "diff_id", "borrowed_objects")["children"]


def p4_child_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the attributes of those children."""
    return nested.flatten_borrowed(table(spark, d, "cfe_diffs"), "diff_id", "borrowed_objects")["attributes"]


def p4_attributes(spark: SparkSession, d: str) -> DataFrame:
    """The deepest flat tables with their parent links."""
    a = nested.flatten_fields(table(spark, d, "config_objects"), "obj_id", "fields")["attributes"]
    b = nested.flatten_borrowed(table(spark, d, "cfe_diffs"), "diff_id", "borrowed_objects")["attributes"]
    one = a.select(F.lit("config_objects").alias("src"), "rec_id", F.col("field_idx").alias("parent_idx"), F.lit(-1).alias("child_idx"), "attr_idx", F.col("field_name").alias("parent_name"), "name")
    two = b.select(F.lit("cfe_diffs").alias("src"), "rec_id", F.col("object_idx").alias("parent_idx"), "child_idx", "attr_idx", F.col("child_name").alias("parent_name"), "name")
    return one.unionByName(two)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "methods"), "version", "source_file", ("loaded_at", "id"), METHOD_TEXTS, ("params_json", "see_also_json"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of added, removed and changed records per pair of versions; here the text columns count, not the JSON ones."""
    changes = snapshots.snapshot_changes(table(spark, d, "methods"), "version", "source_file", ("loaded_at", "id"), METHOD_TEXTS)
    return changes.groupBy("version_from", "version_to", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_values, p4_found, p4_fields, p4_objects, p4_children, p4_child_attributes, p4_attributes, p6_found, p6_report)}

# a borrowed object, its children and their attributes, each with its place from 0; null elements give no row
_OBJECTS = "WITH o AS (SELECT diff_id AS rec_id, unnest(borrowed_objects) AS o, (generate_subscripts(borrowed_objects, 1) - 1)::INTEGER AS object_idx FROM cfe_diffs WHERE borrowed_objects IS NOT NULL)"
_CHILDREN = _OBJECTS + ", c AS (SELECT rec_id, object_idx, o.object_ref AS object_ref, unnest(o.child_objects) AS c, (generate_subscripts(o.child_objects, 1) - 1)::INTEGER AS child_idx FROM o WHERE o IS NOT NULL AND o.child_objects IS NOT NULL)"
_ATTRIBUTES = _CHILDREN + ", a AS (SELECT rec_id, object_idx, child_idx, object_ref, c.name AS child_name, unnest(c.attributes) AS a, (generate_subscripts(c.attributes, 1) - 1)::INTEGER AS attr_idx FROM c WHERE c IS NOT NULL AND c.attributes IS NOT NULL)"
SQL = {
    "p4_objects": _OBJECTS + " SELECT rec_id, object_idx, o.object_ref AS object_ref, o.object_type AS object_type, o.object_name AS object_name, o.object_belonging AS object_belonging, o.has_modifications AS has_modifications, o.found_in_config AS found_in_config, o.xml_path AS xml_path FROM o WHERE o IS NOT NULL",
    "p4_children": _CHILDREN + " SELECT rec_id, object_idx, child_idx, object_ref, c.kind AS kind, c.name AS name FROM c WHERE c IS NOT NULL",
    "p4_child_attributes": _ATTRIBUTES + " SELECT rec_id, object_idx, child_idx, attr_idx, object_ref, child_name, a.name AS name, a.kind AS kind FROM a WHERE a IS NOT NULL",
    "p6_report": r"""WITH m AS (SELECT trim(regexp_replace(version, '\s+', ' ', 'g')) AS v, source_file, loaded_at, id,
  list_transform([title, name_ru, name_en, category, version_since, version_deprecated, syntax, returns, description, availability, example], lambda x: trim(regexp_replace(regexp_replace(coalesce(x, ''), '[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '\s+', ' ', 'g')))::VARCHAR AS t FROM methods WHERE source_file IS NOT NULL),
 l AS (SELECT * FROM m WHERE regexp_full_match(v, '[0-9]+([.][0-9]+)*') QUALIFY row_number() OVER (PARTITION BY v, source_file ORDER BY loaded_at DESC, id DESC) = 1),
 n AS (SELECT v, row_number() OVER (ORDER BY list_transform(string_split(v, '.'), lambda p: p::BIGINT)) AS i FROM (SELECT DISTINCT v FROM l)),
 r AS (SELECT l.*, n.i FROM l JOIN n USING (v)), p AS (SELECT a.v AS version_from, b.v AS version_to, a.i FROM n a JOIN n b ON b.i = a.i + 1),
 x AS (SELECT p.version_from, p.version_to, coalesce(a.source_file, b.source_file) AS f, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'changed' END AS change
  FROM (SELECT r.*, r.i AS pair FROM r) a FULL JOIN (SELECT r.*, r.i - 1 AS pair FROM r WHERE r.i > 1) b ON a.pair = b.pair AND a.source_file = b.source_file JOIN p ON p.i = coalesce(a.pair, b.pair))
 SELECT version_from, version_to, change, count(*) AS n FROM x WHERE change IS NOT NULL GROUP BY ALL""",
}
