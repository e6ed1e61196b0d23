"""References to records that do not exist.

``orphans`` marks every reference that names no living record at the reference's time (direct), and then cascades: a
record that holds an orphan reference is itself unreliable, so references to *it* are inherited orphans, and so on down
the foreign-key graph until a fixpoint.  Each round is one semi-join of the edges between records with the records found
last; the lineage is cut after every round, and rounds are appended, not rewritten.

Everything that depends on time is a timeline: the births and deaths of the lives of a key, its deliveries and the
references to it, sorted by time.  A running sum tells whether some life holds, the last delivery is the record in force.
So a pass costs one shuffle and one sort of the narrow references, whatever the number of lives.  A key that holds more
than a task's share of the references is spread over as many tasks as it needs, and only its few steps are copied.

Null keys or times are no reference.  Repeated references stay repeated.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.nested import field_tree
from ledgerloom.session import checkpointed

# fixed values: metadata kinds, English singular form <- Russian and English spellings (as a type or as a reference type)
KINDS = {
    "catalog": ("справочник", "catalog"),
    "document": ("документ", "document"),
    "enum": ("перечисление", "enum"),
    "informationregister": ("регистрсведений", "informationregister"),
    "accumulationregister": ("регистрнакопления", "accumulationregister"),
    "chartofcharacteristictypes": ("планвидовхарактеристик", "chartofcharacteristictypes"),
    "definedtype": ("определяемыйтип", "definedtype"),
}

_SPELLINGS = {s: k for k, ss in KINDS.items() for s in ss}
BLANKS = " \t\n\x0b\f\r"
# a type as it stands before the full stop: singular, plural or as a type of references
_HEADS = {s + end: k for s, k in _SPELLINGS.items() for end in ("", "ref", "ссылка", "s")}
_REFERENCE = r"(?<![\p{L}\p{N}_.])(?iu:(" + "|".join(_SPELLINGS) + r")(?:ref|ссылка|s|)?)\s*+\.\s*+([\p{L}_][\p{L}\p{N}_]*+)"


def _kind_of(spelling: Column) -> Column:
    mapping = F.create_map(*(F.lit(x) for kv in _SPELLINGS.items() for x in kv))
    return F.try_element_at(mapping, F.lower(spelling))


def canonical(match: Column) -> Column:
    """``type.name`` in lower case of one matched reference; null if the kind is none of ``KINDS``."""
    kind = _kind_of(F.regexp_extract(match, _REFERENCE, 1))
    return F.concat(kind, F.lit("."), F.lower(F.regexp_extract(match, _REFERENCE, 2)))


def references_in(text: Column) -> Column:
    """All references in a text (a type expression with any separators), distinct."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), canonical), lambda r: r.isNotNull()))


def leading_reference(text: Column) -> Column:
    """The reference a table name starts with (a virtual table, section or parameter list may follow); else null."""
    stop = F.instr(text, ".")
    spelled = F.lower(F.btrim(F.substring(text, F.lit(1), stop - 1), F.lit(BLANKS)))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in _HEADS.items() for x in kv)), spelled)
    name = F.regexp_extract(F.substring(text, stop + 1, F.length(text)), r"^\s*+([\p{L}_][\p{L}\p{N}_]*+)", 1)
    return F.when((stop > 0) & (name != ""), F.concat(kind, F.lit("."), F.lower(name)))


def lives(objects: DataFrame) -> DataFrame:
    """ref, at, delta: at which times how many more (or fewer) objects of that type and name exist.

    Of each uuid the row with the latest ``loaded_at`` counts (the larger ``obj_id`` on a tie); a life that ends before it
    begins is none; one without a creation time is none.
    """
    latest = (
        objects.groupBy("uuid")
        .agg(F.max_by(F.struct("object_type", "object_name", "created_at", "deleted_at"), F.struct("loaded_at", "obj_id")).alias("x"))
        .select(owner_of("x.object_type", "x.object_name").alias("ref"), F.col("x.created_at").alias("born"), F.col("x.deleted_at").alias("died"))
        .where("ref IS NOT NULL AND born IS NOT NULL AND (died IS NULL OR born < died)")
    )
    steps = latest.select("ref", F.inline(F.array(F.struct(F.col("born").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("died").alias("at"), F.lit(-1).alias("delta")))))
    return steps.where("at IS NOT NULL").groupBy("ref", "at").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def owner_of(kind: str, name: str) -> Column:
    """The reference by which an object is named; null if its type or name is none."""
    return F.concat(_kind_of(F.trim(kind)), F.lit("."), F.lower(F.trim(name)))


def deliveries(objects: DataFrame) -> DataFrame:
    """ref, at, record: the delivered rows of every object, each in force until the next one of that type and name."""
    return objects.select(owner_of("object_type", "object_name").alias("ref"), F.col("loaded_at").alias("at"), F.col("obj_id").alias("record")).where("ref IS NOT NULL AND at IS NOT NULL")


def hot_keys(refs: DataFrame) -> DataFrame:
    """ref, parts: the keys with more references than an even task has, and how many tasks such a key is spread over.

    There are never more of them than tasks, which bounds the table for broadcasting.
    """
    tasks = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = checkpointed(refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") * tasks > total).select("ref", F.ceil(F.col("n") * tasks / F.lit(max(total, 1))).cast("int").alias("parts"))


def at_time(refs: DataFrame, alive: DataFrame, records: DataFrame | None, hot: DataFrame) -> DataFrame:
    """``refs`` (src, rec_id, ref, ts) with ``exists`` and the columns ``record`` and ``level`` of the delivery in force.

    ``alive`` are the steps of ``lives``; ``records`` the deliveries (ref, at, record, level).  What happens at the very
    time of a reference counts as before it.
    """
    key = refs.schema["rec_id"].dataType.simpleString()
    none = F.lit(None)

    def line(df: DataFrame, at: str, side: int, delta: Column = F.lit(0), record: Column = none, level: Column = none, src: Column = none, rec_id: Column = none) -> DataFrame:
        return df.select(
            "ref", F.col(at).alias("ts"), F.lit(side).alias("side"), delta.cast("long").alias("delta"), record.cast("long").alias("record"), level.cast("int").alias("level"),
            src.cast("string").alias("src"), rec_id.cast(key).alias("rec_id"),
        )

    steps = line(alive, "at", 0, delta=F.col("delta"))
    if records is not None:
        steps = steps.unionByName(line(records, "at", 1, record=F.col("record"), level=F.coalesce("level", F.lit(-1))))
    points = line(refs, "ts", 2, src=F.col("src"), rec_id=F.col("rec_id"))
    few = F.broadcast(hot)  # at most one row per task
    points = points.join(few, "ref", "left").withColumn("part", F.pmod(F.xxhash64("rec_id", "ts"), F.coalesce("parts", F.lit(1))).cast("int"))
    steps = steps.join(few, "ref", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    w = Window.partitionBy("ref", "part").orderBy("ts", "side", "record").rowsBetween(Window.unboundedPreceding, 0)
    placed = points.unionByName(steps).withColumns(
        {"exists": F.sum("delta").over(w) > 0, "in_force": F.last(F.when(F.col("side") == 1, F.struct("record", "level")), ignorenulls=True).over(w)}
    )
    return placed.where("side = 2").select("src", "rec_id", "ref", "ts", "exists", "in_force.record", "in_force.level")


def config_references(query_tables: DataFrame, config_objects: DataFrame, cfe_diffs: DataFrame) -> DataFrame:
    """src, rec_id, ref, ts of the three referring tables, one row per record and reference."""
    q = query_tables.select(F.lit("query_tables").alias("src"), F.col("qt_id").alias("rec_id"), leading_reference(F.col("full_name")).alias("ref"), F.col("seen_at").alias("ts"))
    d = cfe_diffs.select(
        F.lit("cfe_diffs").alias("src"),
        F.col("diff_id").alias("rec_id"),
        F.explode(F.array_distinct(F.transform("not_in_config", leading_reference))).alias("ref"),
        F.col("run_at").alias("ts"),
    )
    o = field_references(config_objects).select(F.lit("config_objects").alias("src"), F.col("obj_id").alias("rec_id"), "ref", F.col("loaded_at").alias("ts"))
    return q.unionByName(o).unionByName(d).where("ref IS NOT NULL AND ts IS NOT NULL")


def field_references(config_objects: DataFrame) -> DataFrame:
    """obj_id, loaded_at, owner (the object's own ref), ref: every reference in a data_type inside ``fields``."""
    keyed = config_objects.select(
        F.struct("obj_id", "loaded_at", owner_of("object_type", "object_name").alias("owner")).alias("k"), "fields"
    )
    types = F.flatten(F.transform("tree", lambda f: F.concat(F.array(f["data_type"]), F.transform(f["attrs"], lambda a: a["data_type"]))))
    text = F.concat_ws(" ; ", types)
    return field_tree(keyed, "k", "fields").select("rec_id.*", F.explode(references_in(F.regexp_replace(text, r"\\[nrt]", " "))).alias("ref"))


def orphans(refs: DataFrame, alive: DataFrame, records: DataFrame | None = None, source: str = "config_objects") -> DataFrame:
    """src, rec_id, ref, ts, depth of every orphan reference: depth 0 direct, n inherited over n steps.

    ``records`` are the ``deliveries`` of the table ``source``, whose rows can both refer and be referred to: a reference
    that exists, but whose record in force holds an orphan reference (direct or inherited), is an inherited orphan of the
    next depth.  A reference has its least depth.  Stops when a round finds no record (cycles end by themselves).  Without
    ``records`` only direct orphans are found.
    """
    hot = hot_keys(refs)
    if records is None:
        return at_time(refs, alive, None, hot).where("NOT exists").select("src", "rec_id", "ref", "ts", F.lit(0).alias("depth"))
    plain = records.withColumn("level", F.lit(None).cast("int"))
    own = checkpointed(at_time(refs.where(F.col("src") == source), alive, plain, hot).select("rec_id", "exists", "record"))
    edges = own.where("exists AND record IS NOT NULL AND record <> rec_id").select("rec_id", F.col("record").alias("parent")).distinct()
    frontier = checkpointed(own.where("NOT exists").select("rec_id").distinct())
    known, level, pieces = frontier.withColumn("level", F.lit(0)), 0, 1
    edges = checkpointed(edges)
    while not frontier.isEmpty():
        level += 1
        reached = edges.join(frontier.select(F.col("rec_id").alias("parent")), "parent", "left_semi").select("rec_id").distinct()
        frontier = checkpointed(reached.join(known.select("rec_id"), "rec_id", "left_anti"))
        known, pieces = known.unionByName(frontier.withColumn("level", F.lit(level))), pieces + 1
        if pieces == 20:  # keeps the plan short on deep graphs
            known, pieces = checkpointed(known), 1
    judged = records.join(known.withColumnRenamed("rec_id", "record"), "record", "left")
    depth = F.when(~F.col("exists"), 0).when(F.col("level") >= 0, F.col("level") + 1)
    return at_time(refs, alive, judged, hot).select("src", "rec_id", "ref", "ts", depth.alias("depth")).where("depth IS NOT NULL")


def orphan_report(found: DataFrame) -> DataFrame:
    """src, month, direct, inherited: counts of distinct (record, reference) per table and month of the record's time."""
    return (
        found.withColumn("month", F.date_format(F.date_trunc("month", "ts"), "yyyy-MM"))
        .groupBy("src", "month", "rec_id", "ref")
        .agg(F.min("depth").alias("depth"))
        .groupBy("src", "month")
        .agg(F.count(F.when(F.col("depth") == 0, 1)).alias("direct"), F.count(F.when(F.col("depth") > 0, 1)).alias("inherited"))
    )
