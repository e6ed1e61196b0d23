"""Search, graphs, diffs, metrics, rules, reports, sources, sinks and streams."""

import datetime as dt
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import queries_ops
from ledgerloom.functions import text as tx
from ledgerloom.operators import diff, graph, metrics, reports, rules, search
from ledgerloom.sources import metadata, sinks
from ledgerloom.streaming import pipelines

T = dt.datetime


def test_identifier_words():
    assert tx.identifier_words("СтавкаНДСПоЗначениюПеречисления") == ["Ставка", "НДС", "По", "Значению", "Перечисления"]
    assert tx.identifier_words("GetNDSValue2x") == ["Get", "NDS", "Value"] and tx.identifier_words("") == []
    assert tx.stem("остатками") == "остатк" or len(tx.stem("остатками")) >= 3
    assert tx.stems("НайтиПоКоду", {"найт": "find"})[-1] == "find"


def test_bm25_formula(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c c")], "id int, t string")
    got = {r.id: r.score for r in search.bm25(df, "id", F.split("t", " "), ["a", "a"]).collect()}
    idf, avg = math.log(1 + (3 - 1 + 0.5) / (1 + 0.5)), 3.0
    assert set(got) == {1} and abs(got[1] - idf * (2 * 2.5) / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))) < 1e-12


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "k string, score double")
    b = spark.createDataFrame([("y", 9.0), ("w", 8.0), ("x", 7.0)], "k string, score double")
    got = {r.k: r.score for r in search.rrf([a, b], "k").collect()}
    assert abs(got["x"] - (1 / 61 + 1 / 63)) < 1e-12
    same = spark.createDataFrame([("x", 5.0), ("y", 5.0)], "k string, score double")
    assert {r.score for r in search.min_max(same).collect()} == {5.0}
    assert {r.k: round(r.score, 6) for r in search.comb([a, b], "k", mnz=True).collect()}["y"] == 3.0
    with pytest.raises(ValueError):
        search.weighted_fusion(a, b, "k", 1.5)
    with pytest.raises(ValueError):
        search.rrf([a, b], "k", 0)
    docs = spark.createDataFrame([("x", 3.0, "a b c"), ("y", 2.9, "a b c"), ("z", 2.0, "q r s")], "k string, score double, t string")
    assert [r.k for r in search.mmr(docs, "k", "t", 2, 0.5).orderBy("rank").collect()] == ["x", "z"]


def test_trigrams(spark):
    df = spark.createDataFrame([(1, "найти"), (2, "найтти"), (3, "иное")], "id int, n string")
    got = {r.id: r.score for r in search.trigram_jaccard(df, "id", F.col("n"), "найти").collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1


def test_vector_search_is_exact(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    pdf = v.toPandas()
    m = np.array(pdf["embedding"].tolist(), dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = search.cosine_top(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), 5, block=4, chunk=200).collect()
    for q in {r.query for r in got}:
        s = m @ m[pdf.index[pdf.vec_id == q][0]]
        want = pdf.vec_id.to_numpy()[np.lexsort((pdf.vec_id, -np.round(s, 9)))[:5]]
        assert [r.key for r in sorted(got, key=lambda r: r.rank) if r.query == q] == want.tolist()


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "d", "r")], "src string, dst string, relation string")
    assert {r.node: r.depth for r in graph.transitive(e, "a").collect()} == {"b": 1, "c": 2, "d": 3}
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "c", "d"] and graph.shortest_path(e, "d", "a") == []
    assert [r.path for r in graph.cycles(e).collect()] == [["a", "b", "c"]]
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    s = graph.stats(e, n).first()
    assert (s.nodes, s.edges, s.unused, s.roots) == (5, 4, 1, 1)


def test_diff(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 5)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "z", None), (3, "y", 5)], "k int, v string, n int")
    assert {(r.k, r.change, tuple(r.fields)) for r in diff.keyed_diff(a, b, ["k"], ["v", "n"]).collect()} == {(1, "modified", ("v",)), (2, "removed", ()), (3, "added", ())}
    assert {(r.k, r.state) for r in diff.baseline(a, b, ["k"]).collect()} == {(3, "new"), (2, "fixed")}


def test_indicators(spark):
    calls = spark.createDataFrame([("t", i != 0, float(i)) for i in range(100)] + [("one", True, 7.0)], "tool string, ok boolean, ms double")
    got = {r.tool: r for r in metrics.sli(calls, "tool", F.col("ok"), "ms").collect()}
    assert (got["t"].p50, got["t"].p99, got["t"].failed, got["one"].p99) == (50.0, 99.0, 1, 7.0)
    assert metrics.slo_check(metrics.sli(calls, "tool", F.col("ok"), "ms")).where("errors_ok AND latency_ok").count() == 2
    assert metrics.sli(calls.limit(0), "tool", F.col("ok"), "ms").count() == 0


def test_rate_limit_and_ttl(spark):
    ev = spark.createDataFrame([(1, "k", T(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2, 3)] + [(2, "k", T(2024, 1, 1, 0, 1, 1))], "id int, key string, ts timestamp")
    assert [r.accepted for r in metrics.rate_limit(ev, "key", "ts", 2, 60).orderBy("ts").collect()] == [True, True, False, False, True]
    assert metrics.ttl_fifo(ev, "key", "ts", "id", F.lit(T(2024, 1, 1, 0, 0, 10)), 3600, 2).count() == 2


def test_code_metrics(spark):
    df = spark.createDataFrame([(1, "Процедура А()\n\t// Если\n\tЕсли Б И В Тогда\n\tКонецЕсли;\n\nКонецПроцедуры\n"), (2, None), (3, "")], "id int, c string")
    got = {r.id: r for r in metrics.code_metrics(df, "id", "c").collect()}
    assert (got[1].total, got[1].comment, got[1].blank, got[1].methods, got[1].cyclomatic) == (7, 1, 2, 1, 3) and got[2].methods == 0
    block = "\n".join(f"А{i} = {i};" for i in range(8))
    dup = metrics.duplicate_blocks(spark.createDataFrame([(1, block), (2, block), (3, "x")], "id int, c string"), "id", "c")
    assert dup.count() == 3 and {(r.occurrences, r.files) for r in dup.collect()} == {(2, 2)}


POSITIVE = {
    "SEC004": 'Пароль = "x1";', "SEC010": 'А = "http://host";', "STD456-NBSP": "А\u00a0= 1;", "STD456-LENGTH": "а" * 121, "STD456-YO": "Счётчик = 1;", "STD547": "Перейти ~Метка;", "STD643": "Д = ТекущаяДата();",
    "STD686": "Отказ = Ложь;", "BSL-SELF": "А = А;", "ARC-TERNARY": "Б = ?(А, 1, 2);", "SEC006": 'О = Новый COMОбъект("X");', "STD456-MULTI": "А = 1; Б = 2;", "BSL-PARAMS": "Процедура А(б, в, г, д, е, ж, з, и)",
}
NEGATIVE = {"SEC002": 'Выполнить("x")', "SEC010": 'А = "http://localhost";', "STD456-YO": 'А = "ё";', "STD456-TODO": "// TODO №12 сделать", "BSL-SELF": "А = Б;", "STD456-SPACE": "// хорошо", "STD456-MULTI": 'А = "; ;";'}


def test_line_rules(spark):
    df = spark.createDataFrame([(k, 1, t) for k, t in POSITIVE.items()], "want string, line int, text string")
    hit = {(r.want, r.rule_id) for r in rules.check_lines(df).collect()}
    assert all((k, k) in hit for k in POSITIVE)
    df = spark.createDataFrame([(k, 1, t) for k, t in NEGATIVE.items()], "want string, line int, text string")
    assert not {(r.want, r.rule_id) for r in rules.check_lines(df).collect()} & {(k, k) for k in NEGATIVE}
    assert len({r.id for r in rules.LINE_RULES}) == len(rules.LINE_RULES)


def test_query_rules(spark):
    texts = {"Q001": "ВЫБРАТЬ * ИЗ Справочник.А", "Q009": "ВЫБРАТЬ А ИЗ Т СОЕДИНЕНИЕ Б ГДЕ 1=1", "Q018": "ВЫБРАТЬ А ОБЪЕДИНИТЬ ВЫБРАТЬ Б", "O003": "SELECT a FROM t FULL OUTER JOIN b ON 1=1", "Q005": 'ВЫБРАТЬ А ИЗ Т ГДЕ А ПОДОБНО "%x"', "O001": "SELECT TOP 5 a FROM t", "Q014": 'ВЫБРАТЬ "а ИЗ Т'}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    hit = {(r.k, r.rule_id) for r in rules.check_queries(df, "k", "t").collect()}
    assert all((k, k) in hit for k in texts) and ("Q018", "Q001") not in hit


def test_context_and_state_rules(spark):
    code = "Функция А() Экспорт\n\tНачатьТранзакцию();\n\tНачатьТранзакцию();\n\tДля Каждого Б Из В Цикл\n\t\tЗ = Новый Запрос;\n\t\tО.Записать();\n\tКонецЦикла;\n\tЗафиксироватьТранзакцию();\nКонецФункции\nПроцедура А()\nКонецПроцедуры"
    df = spark.createDataFrame([(1, code), (2, None), (3, "")], "id int, c string")
    assert {r.rule_id for r in rules.check_stateful(df, "id", "c").collect()} >= {"TX001", "TX005", "TX009", "ARC-QLOOP", "BSL-DUPLICATE", "BSL-RETURN", "STD455"}
    assert {(r.line, r.rule_id) for r in rules.check_context(df, "id", "c").collect()} >= {(6, "SEC011"), (1, "STD-DOC")}


def test_reports(spark):
    a = spark.createDataFrame([("x", 1, 10), ("x", 2, 20), ("y", 1, 5)], "g string, m int, v int")
    got = {(r.g, r.m, r.level): r.t for r in reports.grouped(a, ["g", "m"], {"t": ("Сумма", "v")}).collect()}
    assert got[(None, None, 0)] == 35 and got[("x", None, 1)] == 30 and got[("x", 2, 2)] == 20
    assert reports.union_set([a, a.drop("v")]).count() == 6 and reports.link(a, a, "g", "g").count() == 5
    assert a.where(reports.report_filter(("or", ("g", "BeginsWith", "y"), ("not", ("m", "Less", 2))))).count() == 2
    f = spark.createDataFrame([("s", "dataset", "Сумма", "Сумма продаж", None), ("s", "total", "Сумма", "", "Сумма(Сумма)"), ("s", "calculated", "Доля", "", "Сумма / Всего")], "schema string, part string, name string, title string, expression string")
    assert {(r.part, r.link) for r in reports.lineage(f, "сумма").collect()} == {("dataset", "match"), ("total", "match"), ("calculated", "uses")}
    assert {r.part for r in reports.lineage(f, "продаж").collect()} >= {"dataset"}


XML = """<MetaDataObject xmlns="http://v8"><Catalog uuid="u1"><Properties><Name>Товары</Name><Synonym><item><content>Товары склада</content></item></Synonym><Comment/><CodeLength>9</CodeLength></Properties>
<ChildObjects><Attribute uuid="a1"><Properties><Name>Склад</Name><Type><Type>cfg:CatalogRef.Склады</Type><Type>xs:string</Type></Type></Properties></Attribute><TabularSection uuid="t1"><Properties><Name>Состав</Name></Properties>
<ChildObjects><Attribute uuid="a2"><Properties><Name>Документ</Name><Type><Type>cfg:DocumentRef.Заказ</Type></Type></Properties></Attribute></ChildObjects></TabularSection><Form>ФормаСписка</Form></ChildObjects></Catalog></MetaDataObject>"""


def test_metadata_scan(spark, tmp_path):
    (tmp_path / "Catalogs").mkdir()
    (tmp_path / "Catalogs/Товары.xml").write_text(XML, encoding="utf-8")
    (tmp_path / "Catalogs/bad.xml").write_text("<a>", encoding="utf-8")
    df = metadata.scan_objects(spark, str(tmp_path))
    ok = df.where("error IS NULL").first()
    assert (ok.type, ok.name, ok.uuid, ok.synonym, ok.properties["CodeLength"]) == ("Catalog", "Товары", "u1", "Товары склада", "9")
    assert [(c.kind, c.name, c.section) for c in ok.children] == [("Attribute", "Склад", None), ("TabularSection", "Состав", None), ("Attribute", "Документ", "Состав"), ("Form", "ФормаСписка", None)]
    assert df.where("error IS NOT NULL").count() == 1
    assert {(r.dst, r.relation) for r in metadata.reference_edges(df).collect()} == {("Catalog.Склады", "attribute"), ("Document.Заказ", "tabular_section")}
    s = metadata.object_statistics(df.where("error IS NULL")).first()
    assert (s.objects, s.attributes, s.sections, s.forms) == (1, 2, 1, 1)


def test_rights_forms_schemas_modules(spark, tmp_path):
    (tmp_path / "Rights.xml").write_text("<Rights><object><name>Catalog.X</name><right><name>Read</name><value>true</value><restrictionByCondition><condition>ГДЕ А</condition></restrictionByCondition></right></object></Rights>", encoding="utf-8")
    (tmp_path / "Form.xml").write_text('<Form><ChildItems><UsualGroup name="Г"><ChildItems><InputField name="П"><DataPath>Объект.А</DataPath></InputField></ChildItems></UsualGroup></ChildItems></Form>', encoding="utf-8")
    (tmp_path / "Template.xml").write_text("<S><dataSets><dataSet><name>Н</name><query>ВЫБРАТЬ</query><field><dataPath>А</dataPath><title>Т</title></field></dataSet></dataSets><totalField><dataPath>А</dataPath><expression>Сумма(А)</expression><group>Г1</group><group>Г2</group></totalField></S>", encoding="utf-8")
    ext = tmp_path / "CommonModules/Общий/Ext"
    ext.mkdir(parents=True)
    (ext / "Module.bsl").write_text("Процедура А()\nКонецПроцедуры", encoding="utf-8")
    r = metadata.scan_rights(spark, str(tmp_path)).first()
    assert (r.object, r.right, r.value, r.restriction) == ("Catalog.X", "Read", "true", "ГДЕ А")
    assert [(x.item_path, x.depth, x.data_path) for x in metadata.scan_forms(spark, str(tmp_path)).collect()] == [("Г", 0, None), ("Г/П", 1, "Объект.А")]
    assert {(x.part, tuple(x.groups)) for x in metadata.scan_report_schemas(spark, str(tmp_path), "Template.xml").collect()} == {("dataset", ()), ("total", ("Г1", "Г2"))}
    assert metadata.scan_modules(spark, str(tmp_path)).first().code.startswith("Процедура")


def test_help_pages(spark):
    df = spark.createDataFrame([(1, "<html><h1>Метод &amp; имя</h1><p>Доступен с 8.3.9. Тонкий клиент, сервер.</p></html>"), (2, None)], "id int, page string")
    r = metadata.help_pages(df, "id", "page").where("id = 1").first()
    assert (r.title, r.version_since, r.version_deprecated, r.thin_client, r.server, r.web_client) == ("Метод & имя", "8.3.9", None, True, True, False)


def block(body: bytes) -> bytes:
    return b"\r\n%08x %08x %08x \r\n" % (len(body), len(body), 0x7FFFFFFF) + body


def test_container(spark, tmp_path):
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    content = raw.compress("текст".encode()) + raw.flush()
    name = block(b"\0" * 20 + "имя".encode("utf-16-le") + b"\0\0")
    toc_size = len(block(b"\0" * 12))
    at_name = 16 + toc_size
    data = b"\xff\xff\xff\x7f" + b"\0" * 12 + block(struct.pack("<III", at_name, at_name + len(name), 0x7FFFFFFF)) + name + block(content)
    (tmp_path / "a.cf").write_bytes(data)
    r = metadata.scan_containers(spark, str(tmp_path)).first()
    assert (r.name, r.content.decode()) == ("имя", "текст") and metadata.read_container(b"") == []


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([("m.bsl", 3, "SEC004", "CRITICAL", "password"), ("m.bsl", None, "X", "odd", "y")], "path string, line int, rule_id string, severity string, message string")
    import json

    got = [json.loads(r.result) for r in sinks.sarif_results(v, "path", "line").collect()]
    assert [(g["ruleId"], g["level"], g["locations"][0]["physicalLocation"]["region"]["startLine"]) for g in got] == [("SEC004", "error", 3), ("X", "warning", 1)]
    sinks.write_sarif(v, "path", "line", str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s/results")).count() == 2
    sinks.publish(v, str(tmp_path / "p"), {"dim": 3})
    assert sinks.load_published(spark, str(tmp_path / "p"), {"dim": 3}).count() == 2 and sinks.load_published(spark, str(tmp_path / "p"), {"dim": 4}) is None
    for i in range(3):
        sinks.append_log(spark.createDataFrame([(i, "x")], "timestamp long, tool string"), str(tmp_path / "log"))
    assert [r.timestamp for r in sinks.read_recent(spark, str(tmp_path / "log"), "timestamp long, tool string", 2).collect()] == [2, 1]


def test_streams(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = pipelines.event_stream(spark, data, schema)
    batch = spark.read.parquet(f"{data}/events.parquet")
    tumbling = pipelines.drain(pipelines.windowed(stream, "1 hour"), str(tmp_path / "a"), "complete")
    assert tumbling.agg(F.sum("n")).first()[0] == batch.count()
    limited = pipelines.drain(pipelines.rate_limited(stream, "event_type", 5, 600), str(tmp_path / "b"))
    want = metrics.rate_limit(batch.withColumn("ts", F.col("ts").cast("timestamp")).select("event_type", "ts"), "event_type", "ts", 5, 600)
    assert limited.where("accepted").count() == want.where("accepted").count()
    q = pipelines.new_against_baseline(stream, batch.where("event_id > 100"), "event_id", str(tmp_path / "new"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "new")).count() == batch.where("event_id <= 100").count()


def test_registered_windows_are_whole(spark, data):
    """The registered streams give every window and session of the batch, those at the end of the input too."""
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, w in (("stream_tumbling", F.window("ts", "1 hour")), ("stream_sliding", F.window("ts", "1 hour", "30 minutes"))):
        want = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        want = want.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")
        got = queries_ops.QUERIES[name](spark, data)
        assert got.count() == want.count() > 0
        assert got.join(want.withColumnRenamed("total", "right"), ["start", "end", "event_type", "n"]).where("abs(total - right) < 1e-3").count() == want.count()
    want = events.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    want = want.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    assert sorted(map(tuple, queries_ops.QUERIES["stream_session"](spark, data).collect())) == sorted(map(tuple, want.collect()))
