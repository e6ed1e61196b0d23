"""Queries over source code, its call graph and rules, catalogue look-ups, and exports of metadata, with SQL where it can
express them."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import queries_engine
from ledgerloom.functions import text as tx
from ledgerloom.operators import code, diff, graph, hierarchy, metrics, reports, rules, search
from ledgerloom.session import shared_folder, spread, table
from ledgerloom.sources import metadata, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- source code
def _modules(spark, d):
    return spread(table(spark, d, "bsl_modules").select("module_id", "module_path", "bsl_code"))


_LINES = "SELECT module_id, module_path, unnest(t) AS text, generate_subscripts(t, 1)::INTEGER AS line FROM (SELECT module_id, module_path, regexp_split_to_array(bsl_code, '\\r\\n|\\n|\\r') AS t FROM bsl_modules WHERE bsl_code IS NOT NULL)"
_HEAD = r"(?i)^[\s\x{feff}]*(?:(?:асинх|async)\s+)?(процедура|функция|procedure|function)\s+([\p{L}\p{N}_]+)\s*[(]"


@query(f"WITH l AS ({_LINES}) SELECT module_id AS rec_id, regexp_extract(text, '{_HEAD}', 2) AS method, CASE WHEN lower(regexp_extract(text, '{_HEAD}', 1)) IN ('функция', 'function') THEN 'function' ELSE 'procedure' END AS kind, line FROM l WHERE regexp_matches(text, '{_HEAD}')")
def code_methods(spark, d):
    """Every procedure and function with the line of its header."""
    return code.methods_of(_modules(spark, d), "module_id", "module_path", "bsl_code").select("rec_id", "method", "kind", "line")


@query()
def code_exported_api(spark, d):
    return code.exported_api(code.methods_of(_modules(spark, d), "module_id", "module_path", "bsl_code"))


def _calls(spark, d):
    return code.call_graph(_modules(spark, d), "module_id", "module_path", "bsl_code")


@query()
def code_call_graph(spark, d):
    """Calls between the configuration's own methods."""
    return code.known_calls(_calls(spark, d), code.methods_of(_modules(spark, d), "module_id", "module_path", "bsl_code"))


@query()
def code_call_statistics(spark, d):
    return code.call_statistics(_calls(spark, d))


@query()
def code_dead_exports(spark, d):
    return code.dead_exports(_calls(spark, d), code.methods_of(_modules(spark, d), "module_id", "module_path", "bsl_code"))


@query()
def code_module_findings(spark, d):
    return code.module_findings(_modules(spark, d), "module_id", "module_path", "bsl_code")


@query()
def rule_methods(spark, d):
    return rules.check_methods(_modules(spark, d), "module_id", "module_path", "bsl_code")


@query()
def rule_context_availability(spark, d):
    m = code.methods_of(_modules(spark, d), "module_id", "module_path", "bsl_code")
    return rules.check_context_availability(_calls(spark, d), table(spark, d, "methods"), m)


_TEXTS = sorted(queries_engine.TEXTS.items())


@query(rules.queries_sql("SELECT 'engine' AS src, name AS rec_id, 1 AS pos, query FROM (VALUES " + ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in _TEXTS) + ") v(name, query)"))
def rule_engine_queries(spark, d):
    """The query rules over the engine's own query texts."""
    df = spark.createDataFrame([("engine", n, 1, t) for n, t in _TEXTS], "src string, rec_id string, pos int, query string")
    return rules.check_queries(df, "rec_id", "query").select("src", "rec_id", "pos", "rule_id")


@query()
def ops_metric_summary(spark, d):
    return metrics.metric_summary(metrics.code_metrics(table(spark, d, "bsl_modules"), "module_id", "bsl_code"))


@query(f"""WITH l AS ({_LINES}), k AS (SELECT module_id, list(trim(text) ORDER BY line) AS k FROM l WHERE trim(text) <> '' AND NOT starts_with(trim(text), '//') GROUP BY 1),
 b AS (SELECT module_id, list_transform(generate_series(1, len(k) - 6), lambda i: array_to_string(list_slice(k, i, i + 5), chr(10))) AS b FROM k WHERE len(k) > 6) SELECT module_id, (len(b) - len(list_distinct(b)))::INTEGER AS n FROM b WHERE len(b) > len(list_distinct(b))""")
def ops_duplicates_per_file(spark, d):
    return metrics.duplicates_per_file(table(spark, d, "bsl_modules"), "module_id", "bsl_code")


# -- graphs and hierarchies beyond a few steps
@query("SELECT a.i AS ancestor, d.i AS descendant, (d.i - a.i)::INTEGER AS depth FROM range(100) a(i), range(100) d(i) WHERE a.i <= d.i")
def hier_closure_chain(spark, d):
    """Every pair on a parent chain of a hundred steps."""
    return hierarchy.closure(spark.range(100).selectExpr("id AS k", "IF(id > 0, id - 1, NULL) AS p"), "k", "p")


_RING = "WITH RECURSIVE e AS (SELECT DISTINCT p_size % 7 AS src, (p_size * 3 + p_partkey) % 7 AS dst FROM part WHERE p_partkey % 7 < 2 AND p_size % 7 <> (p_size * 3 + p_partkey) % 7)"


def _ring(spark, d):
    e = table(spark, d, "part").where("p_partkey % 7 < 2").select((F.col("p_size") % 7).cast("bigint").alias("src"), ((F.col("p_size") * 3 + F.col("p_partkey")) % 7).alias("dst"))
    return e.where("src <> dst").distinct()


@query(_RING + ", p(path, tip) AS (SELECT [src, dst], dst FROM e WHERE src < dst UNION ALL SELECT list_append(path, e.dst), e.dst FROM p JOIN e ON e.src = p.tip WHERE e.dst > path[1] AND NOT list_contains(path, e.dst)) SELECT DISTINCT path::BIGINT[] AS path FROM p JOIN e ON e.src = p.tip AND e.dst = path[1]")
def graph_all_cycles(spark, d):
    """All simple cycles of a small graph, of any length."""
    return graph.cycles(_ring(spark, d))


@query("SELECT * FROM (VALUES (1, 'lineitem', 'orders', 'l_orderkey'), (2, 'orders', 'customer', 'o_custkey'), (3, 'customer', 'nation', 'c_nationkey'), (4, 'nation', 'region', 'n_regionkey')) v(step, src, dst, detail)")
def graph_join_path(spark, d):
    links = [("lineitem", "orders", "l_orderkey"), ("lineitem", "part", "l_partkey"), ("orders", "customer", "o_custkey"), ("customer", "nation", "c_nationkey"), ("supplier", "nation", "s_nationkey"), ("nation", "region", "n_regionkey")]
    return graph.join_path(spark.createDataFrame(links, "src string, dst string, detail string"), "lineitem", "region")


@query("SELECT object_type AS kind, count(*) FILTER (WHERE NOT o AND n) AS added, count(*) FILTER (WHERE o AND NOT n) AS removed, count(*) FILTER (WHERE o AND n AND os IS DISTINCT FROM ns) AS modified FROM (SELECT object_type, object_name, bool_or(loaded_at < TIMESTAMP '2024-01-01') AS o, bool_or(loaded_at >= TIMESTAMP '2024-01-01') AS n, max(synonym) FILTER (WHERE loaded_at < TIMESTAMP '2024-01-01') AS os, max(synonym) FILTER (WHERE loaded_at >= TIMESTAMP '2024-01-01') AS ns FROM config_objects GROUP BY 1, 2) GROUP BY 1 HAVING added + removed + modified > 0")
def diff_counts_by_type(spark, d):
    o = table(spark, d, "config_objects")
    state = lambda x: x.groupBy(F.col("object_type").alias("kind"), F.col("object_name").alias("name")).agg(F.max("synonym").alias("synonym"))
    return diff.change_counts(diff.keyed_diff(state(o.where("loaded_at < '2024-01-01'")), state(o.where("loaded_at >= '2024-01-01'")), ["kind", "name"], ["synonym"]), "kind")


# -- search over an index, and look-ups
def _index(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    return search.TextIndex.build(docs, "doc_id", tx.words_column(F.col("text")))


def _bm25_sql():
    from ledgerloom import queries_ops

    return queries_ops.SQL["search_bm25_scores"], queries_ops.SQL["search_tfidf"]


_BM25, _TFIDF = _bm25_sql()
_ASKED = ["права", "пользователей", "проверяет"]


@query(_BM25)
def search_bm25_indexed(spark, d):
    return _index(spark, d).bm25(_ASKED).select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT * FROM ({_TFIDF}) ORDER BY score DESC, doc_id LIMIT 10")
def search_auto_tfidf(spark, d):
    found = search.search_auto(_index(spark, d), 1, _ASKED, 10_000)
    return search.top(found.withColumn("score", F.round("score", 6)), "score", "doc_id", 10)


def _lists(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL"))
    words = tx.words_column(F.col("text"))
    rounded = lambda terms: search.bm25(docs, "doc_id", words, terms).withColumn("score", F.round("score", 6))
    return rounded(["права", "пользователей"]), rounded(["курсы", "валют"])


def _list_sql(terms):
    from ledgerloom import queries_ops

    return queries_ops._BM25.replace(queries_ops._IN, ", ".join(f"'{t}'" for t in terms)) + " SELECT doc_id, round(score, 6) AS score FROM s"


_FUSED = """WITH a AS (SELECT * FROM ({a}) ORDER BY score DESC, doc_id LIMIT 20), b AS (SELECT * FROM ({b}) ORDER BY score DESC, doc_id LIMIT 20),
 an AS (SELECT doc_id, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS s FROM a, (SELECT min(score) AS lo, max(score) AS hi FROM a)), bn AS (SELECT doc_id, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS s FROM b, (SELECT min(score) AS lo, max(score) AS hi FROM b))
 SELECT doc_id, round(0.5 * coalesce(an.s, 0) + 0.5 * coalesce(bn.s, 0), 6) AS score, CASE WHEN an.s > 0 AND bn.s > 0 THEN 'both' WHEN an.s > 0 THEN 'bm25' WHEN bn.s > 0 THEN 'vector' ELSE 'none' END AS source FROM an FULL JOIN bn USING (doc_id) ORDER BY 0.5 * coalesce(an.s, 0) + 0.5 * coalesce(bn.s, 0) DESC, doc_id LIMIT 10"""


@query(_FUSED.format(a=_list_sql(["права", "пользователей"]), b=_list_sql(["курсы", "валют"])))
def search_hybrid(spark, d):
    return search.hybrid(*_lists(spark, d), "doc_id", 10).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id, score, 'bm25' AS source FROM ({_list_sql(['права', 'пользователей'])}) ORDER BY score DESC, doc_id LIMIT 10")
def search_hybrid_auto(spark, d):
    return search.hybrid_auto(_lists(spark, d)[0], None, "doc_id", 10)


@query()
def search_hybrid_reranked(spark, d):
    out = None
    for way in ("rrf", "weighted", "combsum", "combmnz"):
        part = search.hybrid_reranked(*_lists(spark, d), "doc_id", 5, way).withColumn("way", F.lit(way))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.round("score", 6))


@query()
def search_code(spark, d):
    """Own methods by name (three times) and comment."""
    m = code.methods_of(_modules(spark, d), "module_id", "module_path", "bsl_code").select(F.concat_ws(":", "rec_id", "line").alias("id"), F.col("method").alias("name"), F.col("doc").alias("body"))
    return search.top(search.code_index(m).bm25(tx.stems("НайтиСтрокиПоКоду")), "score", "id", 20)


_NAMED = "lower(trim(coalesce(name_ru, ''))) = 'получитьостатокнадату' OR lower(trim(coalesce(name_en, ''))) = 'получитьостатокнадату'"


@query(f"SELECT id, version, category FROM methods WHERE {_NAMED}")
def lookup_name(spark, d):
    return search.methods_named(table(spark, d, "methods"), "ПолучитьОстатокНаДату").select("id", "version", "category")


@query("SELECT id FROM methods WHERE (lower(trim(coalesce(name_ru, ''))) = 'закрыть' OR lower(trim(coalesce(name_en, ''))) = 'закрыть') AND (contains(lower(trim(coalesce(title, ''))), 'http') OR contains(lower(trim(coalesce(category, ''))), 'http'))")
def lookup_in_context(spark, d):
    return search.methods_named(table(spark, d, "methods"), "Закрыть", "http").select("id")


@query("WITH a AS (SELECT DISTINCT callee AS asked, lower(trim(callee)) AS n FROM (SELECT method_name AS callee FROM context_violations WHERE method_name IS NOT NULL)), m AS (SELECT DISTINCT id, n FROM (SELECT id, lower(trim(name_ru)) AS n FROM methods UNION ALL SELECT id, lower(trim(name_en)) FROM methods) WHERE n IS NOT NULL) SELECT asked, count(*) AS n FROM a JOIN m USING (n) GROUP BY 1")
def lookup_batch(spark, d):
    """All methods called in violations, looked up at once."""
    asked = table(spark, d, "context_violations").where("method_name IS NOT NULL").select(F.col("method_name").alias("name"))
    return search.methods_named_batch(table(spark, d, "methods").select("id", "name_ru", "name_en"), asked).groupBy("asked").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, count(*) AS contexts, sum(n)::BIGINT AS n FROM (SELECT lower(trim(name_ru)) AS name, trim(category) AS c, count(*) AS n FROM methods WHERE name_ru IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
def lookup_collisions(spark, d):
    return search.name_collisions(table(spark, d, "methods"))


_V = "list_transform(string_split(nullif(regexp_extract(coalesce({c}, ''), '[0-9]+(?:[.][0-9]+)*'), ''), '.'), lambda x: x::INTEGER)"
_PAD = "list_slice(list_concat({v}, [0, 0, 0, 0, 0, 0, 0, 0]), 1, 8)"


@query(f"SELECT id FROM methods WHERE (trim(lower(coalesce(availability, ''))) = '' OR contains(lower(availability), 'тонкий клиент')) AND regexp_extract(coalesce(version_deprecated, ''), '[0-9]+(?:[.][0-9]+)*') = '' AND (regexp_extract(coalesce(version_since, ''), '[0-9]+(?:[.][0-9]+)*') = '' OR {_PAD.format(v=_V.format(c='version_since'))} <= [8, 3, 18, 0, 0, 0, 0, 0])")
def lookup_safe_methods(spark, d):
    """Methods a thin client of 8.3.18 can call."""
    return search.safe_methods(table(spark, d, "methods"), ["thin_client"], "8.3.18").select("id")


@query()
def lookup_alternatives(spark, d):
    return search.alternatives(table(spark, d, "methods").where("name_ru IS NOT NULL"), "ПолучитьОстатокНаДату", ["web_client"], 5)


@query("SELECT id::VARCHAR AS id, title, (CASE WHEN contains(lower(coalesce(title, '')), 'файл') THEN 8 ELSE 0 END + CASE WHEN contains(lower(category), 'файл') THEN 5 ELSE 0 END) AS named, greatest((length(lower(coalesce(description, ''))) - length(replace(lower(coalesce(description, '')), 'файл', ''))) // 4, 0) AS hits, (CASE WHEN named > 0 THEN named WHEN hits > 0 THEN 3 + least(hits - 1, 5) ELSE 0 END)::INTEGER AS score FROM methods QUALIFY score > 0 AND row_number() OVER (ORDER BY score DESC, id::VARCHAR) <= 20".replace("SELECT id", "SELECT * EXCLUDE (named, hits) FROM (SELECT id", 1) + ")")
def search_knowledge(spark, d):
    """Catalogue rows scored like entries of a knowledge base, their category as the only keyword."""
    items = table(spark, d, "methods").select(F.col("id").cast("string").alias("id"), "title", F.array("category").alias("keywords"), F.col("description").alias("content"))
    return search.knowledge(items.withColumn("keywords", F.filter("keywords", lambda k: k.isNotNull())), "файл", 20)


@query("SELECT object_name AS name, object_type AS kind FROM config_objects WHERE contains(lower(object_name), 'товар') OR contains(lower(object_name), 'склад') OR contains(lower(object_type), 'товар') OR contains(lower(object_type), 'склад') ORDER BY 1, 2 LIMIT 50")
def search_metadata_words(spark, d):
    o = table(spark, d, "config_objects").select(F.col("object_name").alias("name"), F.col("object_type").alias("kind"))
    return search.holds_words(o, ["name", "kind"], "товар Склад я", 50)


@query()
def gather_context(spark, d):
    """Three of five sources, each with a limit of its own."""
    m = table(spark, d, "methods").select("id", F.col("title"))
    o = table(spark, d, "config_objects").select(F.col("obj_id").alias("id"), F.col("object_name").alias("title"))
    sources = {"platform_methods": search.holds_words(m, ["title"], "остаток файл"), "metadata": search.holds_words(o, ["title"], "товары склад"), "knowledge_base": m.limit(0), "skd": m.limit(0), "forms": o.limit(0)}
    return search.gather(sources, ["platform_methods", "metadata", "best_practices"])[0]


# -- reports
@query("SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice * 0.2::DOUBLE), 2) AS vat FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def report_composed(spark, d):
    """Parameters, calculated fields and field roles together."""
    p = reports.parameters({"since": "1996-01-01 00:00:00"}, {"since": ("date", None), "rate": ("number", 0.2)})
    rows = table(spark, d, "orders").where(F.col("o_orderdate") >= p["since"])
    rows = reports.calculated(rows, {"priority": "o_orderpriority", "total": "o_totalprice", "vat": "tax(total)"}, {"tax": lambda x: x * p["rate"].cast("double")})
    out = reports.compose(reports.with_roles(rows, {"priority": "dimension", "total": "resource", "vat": "resource"}))
    return out.select("priority", F.round("total", 2).alias("total"), F.round("vat", 2).alias("vat"))


@query("SELECT 'C'||c_custkey AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'N'||n_nationkey FROM nation WHERE n_regionkey IN (1, 3) UNION ALL SELECT 'R1' UNION ALL SELECT 'R3'")
def report_filter_hierarchy(spark, d):
    """The filter InListByHierarchy."""
    from ledgerloom.plans.catalog import sample_catalog

    geo = sample_catalog(spark, d).tables["CATALOG.GEOGRAPHY"].df
    roots = spark.createDataFrame([("R1",), ("R3",)], "key string")
    return reports.in_hierarchy(geo, "ref", geo, "ref", "parent", roots).select("ref")


# -- exports: a small one is written into the shared folder and scanned
_OBJECT = """<MetaDataObject xmlns="http://v8"><{kind} uuid="{uuid}"><Properties><Name>{name}</Name><Synonym><item><content>{synonym}</content></item></Synonym><Comment/>{properties}</Properties><ChildObjects>{children}</ChildObjects></{kind}></MetaDataObject>"""
_ATTRIBUTE = "<Attribute uuid=\"a\"><Properties><Name>{name}</Name><Type><Type>cfg:{type}</Type></Type></Properties></Attribute>"


def _export(spark: SparkSession) -> str:
    """Folder of a small configuration export."""
    folder = f"{shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    item = lambda kind, name, synonym="", properties="", children="": _OBJECT.format(kind=kind, name=name, synonym=synonym, properties=properties, children=children, uuid=f"u-{name}")
    files = {
        "Configuration.xml": item("Configuration", "Торговля", "Торговля", "<Version>1.2</Version><Vendor>Кто-то</Vendor><CompatibilityMode>8.3.18</CompatibilityMode>", "<Catalog>Товары</Catalog><Catalog>Склады</Catalog><Document>Заказ</Document><Catalog>Нет</Catalog>"),
        "ConfigDumpInfo.xml": '<ConfigDumpInfo><ConfigVersions><Metadata name="Catalog.Товары" id="1" configVersion="a1"/><Metadata name="Document.Заказ" id="2" configVersion="b2"><Metadata name="Document.Заказ.Attribute.Товар" id="3"/></Metadata></ConfigVersions></ConfigDumpInfo>',
        "Catalogs/Товары.xml": item("Catalog", "Товары", "Товары", "<CheckUnique>true</CheckUnique>", _ATTRIBUTE.format(name="Склад", type="CatalogRef.Склады")),
        "Catalogs/Склады.xml": item("Catalog", "Склады", "", "<CheckUnique>true</CheckUnique>"),
        "Documents/Заказ.xml": item("Document", "Заказ", "Заказ", "<RegisterRecords><Item>AccumulationRegister.Продажи</Item></RegisterRecords>", _ATTRIBUTE.format(name="Товар", type="CatalogRef.Товары") + _ATTRIBUTE.format(name="Основание", type="DocumentRef.Заказ")),
        "Subsystems/Склад.xml": item("Subsystem", "Склад", "Склад", "<Content><Item>Catalog.Товары</Item><Item>Catalog.Склады</Item></Content>"),
        "EventSubscriptions/ПриЗаписи.xml": item("EventSubscription", "ПриЗаписи", "", "<Source><Type>cfg:CatalogObject.Товары</Type></Source><Event>OnWrite</Event><Handler>Общий.ПриЗаписи</Handler>"),
        "Roles/Полные/Ext/Rights.xml": "<Rights><object><name>Catalog.Товары</name><right><name>Read</name><value>true</value><restrictionByCondition><condition>ГДЕ Склад = &amp;С</condition></restrictionByCondition></right><right><name>Delete</name><value>false</value></right></object></Rights>",
        "Catalogs/Товары/Forms/ФормаСписка/Ext/Form.xml": '<Form><ChildItems><UsualGroup name="Г"><ChildItems><InputField name="П"><DataPath>Объект.А</DataPath></InputField><InputField name="П"/></ChildItems></UsualGroup></ChildItems></Form>',
        "Reports/Продажи/Ext/Schema.xml": "<S><dataSets><dataSet><name>Н</name><query>ВЫБРАТЬ * ИЗ Т</query><field><dataPath>А</dataPath><title>Т</title></field><field><dataPath>Б</dataPath></field></dataSet></dataSets><calculatedField><dataPath>В</dataPath><expression>А + Б</expression></calculatedField><totalField><dataPath>Г</dataPath><expression>Сумма(Г)</expression></totalField></S>",
        "CommonModules/Общий/Ext/Module.bsl": "// Записывает товар.\nПроцедура ПриЗаписи(Источник, Отказ) Экспорт\nКонецПроцедуры\n",
        "broken/Плохой.xml": "<a>",
    }
    fs = spark._jvm.org.apache.hadoop.fs
    for name, body in files.items():
        path = fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(body.encode()))
        out.close()
    top = fs.Path(folder)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return folder


@query("SELECT * FROM (VALUES ('Configuration', 'Торговля', 'u-Торговля', 'Торговля', 4), ('Catalog', 'Товары', 'u-Товары', 'Товары', 1), ('Catalog', 'Склады', 'u-Склады', '', 0), ('Document', 'Заказ', 'u-Заказ', 'Заказ', 2), ('Subsystem', 'Склад', 'u-Склад', 'Склад', 0), ('EventSubscription', 'ПриЗаписи', 'u-ПриЗаписи', '', 0)) v(type, name, uuid, synonym, children)")
def source_objects(spark, d):
    df = metadata.scan_objects(spark, _export(spark)).where("error IS NULL AND name <> '' AND uuid IS NOT NULL")
    return df.select("type", "name", "uuid", "synonym", F.size("children").alias("children"))


@query("SELECT 'Catalog.Товары' AS object, unnest(['Read', 'Delete']) AS \"right\", unnest(['true', 'false']) AS value, unnest(['ГДЕ Склад = &С', NULL]) AS restriction")
def source_rights(spark, d):
    return metadata.scan_rights(spark, _export(spark)).select("object", "right", "value", "restriction")


@query("SELECT * FROM (VALUES ('Catalog', 'Товары', 'u-Товары', 'Товары', 'a1'), ('Catalog', 'Склады', 'u-Склады', '', NULL), ('Document', 'Заказ', 'u-Заказ', 'Заказ', 'b2'), ('Catalog', 'Нет', NULL, NULL, NULL)) v(type, name, uuid, synonym, config_version)")
def source_config_index(spark, d):
    folder = _export(spark)
    return metadata.config_index(metadata.scan_objects(spark, folder), metadata.scan_dump_info(spark, folder))


@query("SELECT * FROM (VALUES ('Catalog.Товары', 'Catalog.Склады', 'attribute'), ('Document.Заказ', 'Catalog.Товары', 'attribute'), ('Document.Заказ', 'AccumulationRegister.Продажи', 'recorder'), ('Subsystem.Склад', 'Catalog.Товары', 'subsystem'), ('Subsystem.Склад', 'Catalog.Склады', 'subsystem'), ('EventSubscription.ПриЗаписи', 'Catalog.Товары', 'subscription')) v(src, dst, relation)")
def source_reference_edges(spark, d):
    objects = metadata.scan_objects(spark, _export(spark)).where("error IS NULL")
    return metadata.reference_edges(objects).unionByName(metadata.listing_edges(objects)).select("src", "dst", "relation")


@query("SELECT * FROM (VALUES ('ПриЗаписи', 'EventSubscription', 'OnWrite', 'Общий.ПриЗаписи')) v(name, kind, event, handler)")
def source_subscriptions(spark, d):
    return metadata.subscriptions(metadata.scan_objects(spark, _export(spark)).where("error IS NULL")).select("name", "kind", "event", "handler")


@query("SELECT * FROM (VALUES ('Г', 'UsualGroup', NULL, 0), ('Г/П', 'InputField', 'Объект.А', 1), ('Г/П', 'InputField', NULL, 1)) v(item_path, kind, data_path, depth)")
def source_forms(spark, d):
    return metadata.scan_forms(spark, _export(spark)).select("item_path", "kind", "data_path", "depth")


@query("SELECT * FROM (VALUES ('dataset', 'А', 'Т'), ('dataset', 'Б', ''), ('calculated', 'В', ''), ('total', 'Г', '')) v(part, name, title)")
def source_report_schemas(spark, d):
    return metadata.scan_report_schemas(spark, _export(spark), "Schema.xml").select("part", "name", "title")


@query("SELECT 'Общий' AS module, 'ПриЗаписи' AS method, 'ПриЗаписи(Источник, Отказ)' AS signature, 'Записывает товар.' AS doc")
def source_modules(spark, d):
    modules = metadata.scan_modules(spark, _export(spark)).withColumn("id", F.lit(1))
    return code.exported_api(code.methods_of(modules, "id", "module", "code")).select("module", "method", "signature", "doc")


@query("SELECT unnest(['Form.xml', 'Module.bsl', 'Rights.xml', 'Schema.xml']) AS name")
def source_listing(spark, d):
    return metadata.scan_listing(spark, _export(spark)).select("name")


@query("SELECT * FROM (VALUES ('Catalog', 'Товары', 'catalog-no-list-form'), ('Catalog', 'Товары', 'catalog-no-object-form'), ('Catalog', 'Склады', 'empty-synonym'), ('Catalog', 'Склады', 'catalog-no-list-form'), ('Catalog', 'Склады', 'catalog-no-object-form'), ('Document', 'Заказ', 'document-no-list-form'), ('Document', 'Заказ', 'document-no-check-unique'), ('EventSubscription', 'ПриЗаписи', 'empty-synonym'), ('Configuration', 'Торговля', 'empty-name-prefix')) v(type, name, rule_id)")
def rule_metadata(spark, d):
    objects = metadata.scan_objects(spark, _export(spark)).where("error IS NULL AND name <> '' AND uuid IS NOT NULL")
    return rules.check_metadata(objects).select("type", "name", "rule_id")


@query("SELECT unnest(['FQ002', 'FQ008']) AS rule_id")
def rule_forms(spark, d):
    return rules.check_forms(metadata.scan_forms(spark, _export(spark))).select("rule_id")


@query("SELECT unnest(['SKD003', 'SKD009', 'SKD012']) AS rule_id")
def rule_schemas(spark, d):
    return rules.check_schemas(metadata.scan_report_schemas(spark, _export(spark), "Schema.xml")).select("rule_id")


@query("SELECT count(*) AS n, count(DISTINCT rule_id) AS rules FROM context_violations")
def sink_published_table(spark, d):
    """A table published with its checksum and read back."""
    target = f"{shared_folder(spark)}/exports/{uuid.uuid4().hex}"
    sinks.publish(table(spark, d, "context_violations").select("violation_id", "rule_id"), target, {"kind": "violations"})
    return sinks.load_published(spark, target, {"kind": "violations"}).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_id").alias("rules"))


@query("SELECT violation_id AS id, 'error' AS level FROM context_violations WHERE upper(severity) IN ('CRITICAL', 'HIGH')")
def sink_sarif(spark, d):
    v = table(spark, d, "context_violations").where("upper(severity) IN ('CRITICAL', 'HIGH')")
    out = sinks.sarif_results(v.withColumn("path", F.col("violation_id").cast("string")), "path", "line")
    return out.select(F.get_json_object("result", "$.locations[0].physicalLocation.artifactLocation.uri").cast("bigint").alias("id"), F.get_json_object("result", "$.level").alias("level"))


@query("WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[а-яёa-z0-9]+')) AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) SELECT (SELECT n FROM n)::INTEGER AS docs, count(DISTINCT w) AS terms, (SELECT count(*) FROM (SELECT DISTINCT doc_id, w FROM t)) AS postings, round(count(*) / (SELECT n FROM n)::DOUBLE, 6) AS avg_len FROM t")
def search_index_statistics(spark, d):
    return _index(spark, d).statistics().withColumn("docs", F.col("docs").cast("int"))


def _block(body: bytes) -> bytes:
    return b"\r\n%08x %08x %08x \r\n" % (len(body), len(body), 0x7FFFFFFF) + body


def _container(name: str, body: bytes) -> bytes:
    """A container of one file."""
    head = _block(b"\0" * 20 + name.encode("utf-16-le") + b"\0\0")
    at = 16 + len(_block(b"\0" * 12))
    return b"\xff\xff\xff\x7f" + b"\0" * 12 + _block(struct.pack("<III", at, at + len(head), 0x7FFFFFFF)) + head + _block(body)


@query("SELECT unnest(['а', 'а/б', 'а/б/в', 'а/б/в/г', 'а/б/в/г/текст']) AS name, unnest([NULL, NULL, NULL, NULL, 'ядро']) AS inner_text")
def source_container(spark, d):
    """A container within a container, five deep."""
    data = "ядро".encode()
    for name in ("текст", "г", "в", "б", "а"):
        data = _container(name, data)
    df = spark.createDataFrame([("x.cf", data)], "path string, content binary")
    out = metadata.open_containers(df)
    return out.select("name", F.when(F.col("name").endswith("текст"), F.col("content").cast("string")).alias("inner_text"))


@query("SELECT 1::BIGINT AS id, 'Метод & имя' AS title, '8.3.9' AS version_since, NULL AS version_deprecated, true AS thin_client, true AS server, false AS web_client")
def source_help_pages(spark, d):
    df = spark.createDataFrame([(1, "<html><h1>Метод &amp; имя</h1><p>Доступен с 8.3.9. Тонкий клиент, сервер.</p></html>")], "id long, page string")
    return metadata.help_pages(df, "id", "page").select("id", "title", "version_since", "version_deprecated", "thin_client", "server", "web_client")
