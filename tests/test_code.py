"""Source modules, their calls and rules, catalogue look-ups, reports by roles, and further parts of exports."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom import queries_code
from ledgerloom.functions import text as tx
from ledgerloom.operators import code, graph, metrics, reports, rules, search
from ledgerloom.sources import metadata
from ledgerloom.streaming import pipelines

A = '#Область ПрограммныйИнтерфейс\n// Находит товар.\n&НаСервере\nФункция Найти(Знач Код, Имя = ")", \n\tГде) Экспорт\n\tСклад.Остаток(1);\n\tДелать("x(");\n\tЕсли (1) Тогда\n\tКонецЕсли;\nКонецФункции\n#КонецОбласти\nПроцедура Делать(С)\n\tНайти(1); // Лишнее(2)\nКонецПроцедуры'
B = "Функция Остаток(К) Экспорт\n\tТовары.Найти(1);\n\tВозврат 1;\nКонецФункции\nПроцедура Никто() Экспорт\n"


def modules(spark):
    rows = [(1, "Catalog.Товары.ManagerModule", A), (2, "CommonModule.Склад", B), (3, None, None), (4, "Catalog.Пусто", "")]
    return spark.createDataFrame(rows, "id long, path string, text string")


def test_methods_and_calls(spark):
    df = modules(spark)
    m = code.methods_of(df, "id", "path", "text")
    got = {(r.module, r.method): r for r in m.collect()}
    assert set(got) == {("Товары", "Найти"), ("Товары", "Делать"), ("Склад", "Остаток"), ("Склад", "Никто")}
    first = got["Товары", "Найти"]
    assert (first.kind, first.line, first.last_line, first.exported, first.params, first.directive, first.doc, first.region) == ("function", 4, 10, True, ["Код", "Имя", "Где"], "НаСервере", "Находит товар.", "ПрограммныйИнтерфейс")
    assert got["Склад", "Никто"].last_line == 6 and got["Товары", "Делать"].doc is None
    calls = code.call_graph(df, "id", "path", "text")
    assert {(r.caller_method, r.callee_module, r.callee_method, r.line) for r in calls.collect()} == {("Найти", "Склад", "Остаток", 6), ("Найти", "Товары", "Делать", 7), ("Делать", "Товары", "Найти", 13), ("Остаток", "Товары", "Найти", 2)}
    assert {r.caller_method for r in code.callers(calls, "товары", "НАЙТИ").collect()} == {"Делать", "Остаток"}
    assert {r.callee_method for r in code.callees(calls, "Товары", "Найти").collect()} == {"Остаток", "Делать"}
    assert [tuple(r) for r in code.dead_exports(calls, m).collect()] == [("Склад", "Никто")]
    s = code.call_statistics(calls).first()
    assert (s.edges, s.callers, s.callees, s.nodes) == (4, 3, 3, 3)
    assert sorted(len(r.path) for r in graph.cycles(code.call_edges(calls)).collect()) == [2, 2]
    assert {(r.src, r.dst, r.n) for r in code.module_edges(calls).collect()} == {("товары", "склад", 1), ("склад", "товары", 1)}
    assert code.known_calls(calls, m).count() == 4 and code.exported_api(m).count() == 3
    assert code.methods_of(df.limit(0), "id", "path", "text").count() == 0 == code.call_graph(df.where("id > 2"), "id", "path", "text").count()


def test_query_texts(spark):
    src = 'А = 1;\nЗапрос.Текст = "ВЫБРАТЬ\n\t|\tТ.А КАК ""а""\n\t|ИЗ Т";\nБ.Текст = "";\nЗапрос.Текст = "ВЫБРАТЬ 1";'
    df = spark.createDataFrame([(1, src), (2, None), (3, "")], "id long, t string")
    assert [(r.pos, r.line, r.query) for r in code.query_texts(df, "id", "t").orderBy("pos").collect()] == [(1, 2, 'ВЫБРАТЬ\n\tТ.А КАК "а"\nИЗ Т'), (3, 6, "ВЫБРАТЬ 1")]
    doc = "Вот запрос:\n\nВЫБРАТЬ Т.А\nИЗ Т\n\nТекст.\n```\nselect x\nfrom y\n```\nВыбрать легко.\n"
    docs = spark.createDataFrame([(1, doc), (2, None), (3, "ВЫБРАТЬ " + "А, " * 50_000 + "Б ИЗ Т")], "id long, t string")
    got = {(r.id, r.query.strip()[:20]) for r in code.query_blocks(docs, "id", "t").collect()}
    assert got == {(1, "ВЫБРАТЬ Т.А\nИЗ Т"), (1, "select x\nfrom y"), (3, ("ВЫБРАТЬ " + "А, " * 9)[:20])}


def test_method_rules(spark):
    text = (
        "&НаКлиенте\nПроцедура А(а, б, в, г, д, е) Экспорт\n\tНачатьТранзакцию();\n\tЗ = Новый Запрос;\n\tДля К = 1 По 2 Цикл\n\t\tС = С + \"x\";\n\t\tПолучитьНаСервере();\n\tКонецЦикла;\n\tЗафиксироватьТранзакцию();\nКонецПроцедуры\n"
        "Процедура ПередЗаписью(Отказ)\n\tКонстанты.А.Установить(1);\n\tО = С.ПолучитьОбъект();\n\tВыполнить(К);\nКонецПроцедуры\nПроцедура Пусто()\nКонецПроцедуры\n#Область Пустая\n// ничего\n#КонецОбласти\n#Область О\nЕсли 1 Тогда\n#КонецОбласти"
    )
    df = spark.createDataFrame([(1, "CommonModule.М", text), (2, "x", None)], "id long, path string, t string")
    hit = {(r.line, r.rule_id) for r in rules.check_methods(df, "id", "path", "t").collect()}
    assert hit >= {(3, "CS001"), (4, "CS002"), (7, "CS003"), (2, "CS006"), (2, "MET-PARAMS"), (3, "TX002"), (6, "STD782"), (11, "DX001"), (12, "TX007"), (13, "TX010"), (14, "SEC017"), (16, "AST-EMPTY"), (18, "STR-EMPTY"), (1, "STR-IF")}
    assert not {r for _, r in hit} & {"STR-LOOP", "STR-PROCEDURE", "TX004"}
    big = spark.createDataFrame([(1, "Catalog.А.Form.Ф", "&НаКлиенте\n&НаСервере\n" + "А = 1;\n" * 30 + "О.Записать();\nЗ = Новый Запрос;")], "id long, path string, t string")
    assert {r.rule_id for r in code.module_findings(big, "id", "path", "t").collect()} == {"ARCH007", "ARCH009", "ARCH010"}


QUERY_HITS = {
    "Q006": "ВЫБРАТЬ (ВЫБРАТЬ 1 КАК а) КАК б ИЗ Т КАК Т ГДЕ Т.А = &А", "Q007": "SELECT a AS a FROM T AS T WHERE YEAR(T.d) = &y", "Q012": "ВЫБРАТЬ Т.А КАК А ИЗ Т КАК Т ЛЕВОЕ СОЕДИНЕНИЕ РегистрНакопления.З.Остатки(&П, ) КАК О ПО О.А = Т.А ГДЕ Т.А ЕСТЬ NULL",
    "Q013": "SELECT a AS a FROM T AS T JOIN B AS B ON T.a = B.a OR T.b = B.b WHERE T.a = &a", "O005": "ВЫБРАТЬ О.А КАК А ИЗ РегистрНакопления.З.Остатки(&П, ) КАК О ГДЕ О.А = 1", "Q017": "SELECT T.a, T.b AS b FROM T AS T", "O008": "SELECT 1 AS a FROM T UNION SELECT 2 FROM T",
}


def test_wider_query_rules(spark):
    df = spark.createDataFrame(list(QUERY_HITS.items()), "k string, t string")
    hit = {(r.k, r.rule_id) for r in rules.check_queries(df, "k", "t").collect()}
    assert all((k, k) in hit for k in QUERY_HITS) and ("Q013", "O002") not in hit and ("Q007", "Q013") not in hit
    assert rules.check_queries(df.limit(0), "k", "t").count() == 0


def test_context_availability(spark):
    df = spark.createDataFrame([(1, "М.А", "&НаКлиенте\nПроцедура П()\n\tНайтиФайл(1);\n\tСтарый();\nКонецПроцедуры")], "id long, path string, t string")
    cat = spark.createDataFrame([("НайтиФайл", "Сервер", None), ("Старый", "", "8.3.1")], "name_ru string, availability string, version_deprecated string")
    got = rules.check_context_availability(code.call_graph(df, "id", "path", "t"), cat, code.methods_of(df, "id", "path", "t"))
    assert {(r.line, r.rule_id) for r in got.collect()} == {(3, "CTX001"), (4, "CTX002")}


def test_index_agrees_with_scan(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c c"), (4, None), (5, "")], "id int, t string")
    words = F.split("t", " ")
    index = search.TextIndex.build(docs.where("t IS NOT NULL"), "id", words)
    for q in (["a"], ["c", "b", "b"], ["zzz"]):
        scan = {r.id: round(r.score, 9) for r in search.bm25(docs.where("t IS NOT NULL"), "id", words, q).collect()}
        assert {r.id: round(r.score, 9) for r in index.bm25(q).collect()} == scan
    assert search.search_auto(None, 2, ["a"]) is None and search.search_auto(index, 0, ["a"]) is None
    empty = search.TextIndex.build(docs.limit(0), "id", words)
    assert empty.bm25(["a"]).count() == 0 == empty.tfidf(["a"]).count()


def test_hybrid(spark):
    a = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "k int, score double")
    b = spark.createDataFrame([(2, 9.0), (4, 8.0)], "k int, score double")
    assert {(r.k, r.source) for r in search.hybrid(a, b, "k").collect()} == {(1, "bm25"), (2, "both"), (3, "none"), (4, "none")}
    assert {r.source for r in search.hybrid_auto(a, None, "k", 2).collect()} == {"bm25"}
    got = {r.k: r for r in search.hybrid_reranked(a, b, "k", 3).collect()}
    assert got[2].source == "both" and (got[2].bm25_score, got[2].vector_score) == (2.0, 9.0) and abs(got[2].score - 1 / 62 - 1 / 61) < 1e-12
    with pytest.raises(ValueError):
        search.hybrid_reranked(a, b, "k", 3, "nothing")


def test_lookups(spark):
    m = spark.createDataFrame(
        [(1, "Найти", "Find", "Массив.Найти", "Массив", "Сервер, тонкий клиент", None, "8.3.5"), (2, "найти ", "Find", "Строка.Найти", "Строка", "Сервер", "8.3.20", "8.3.1"), (3, "НайтиВсе", "FindAll", "Массив", "Массив", "Веб-клиент", "", ""), (4, None, None, None, None, None, None, None)],
        "id long, name_ru string, name_en string, title string, category string, availability string, version_deprecated string, version_since string",
    )
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.methods_named(m, "НАЙТИ")) == [1, 2] and ids(search.methods_named(m, "find", "строка")) == [2]
    assert [(r.name, r.contexts) for r in search.name_collisions(m).collect()] == [("найти", 2)]
    assert ids(search.safe_methods(m, ["thin_client"], "8.3.10")) == [1, 4] and ids(m.where(search.deprecated("8.3.10"))) == [] and ids(m.where(search.deprecated("8.3.20"))) == [2]
    assert ids(m.where(search.since("8.3"))) == [3, 4] and ids(m.where(search.since("8.3.5.0"))) == [1, 2, 3, 4]
    assert ids(search.alternatives(m.where("name_ru IS NOT NULL"), "Найти", ["web_client"])) == [3]
    asked = spark.createDataFrame([("Найти",), ("FINDALL",), ("Нет",)], "name string")
    assert sorted((r.asked, r.id) for r in search.methods_named_batch(m, asked).collect()) == [("FINDALL", 3), ("Найти", 1), ("Найти", 2)]
    kb = spark.createDataFrame([("qb", "О запросах", ["запрос"], ""), ("x", "Другое", ["запрос в цикле"], None), ("y", "Иное", None, "запрос, запрос и запрос")], "id string, title string, keywords array<string>, content string")
    assert {r.id: r.score for r in search.knowledge(kb, "запрос").collect()} == {"qb": 18, "x": 5, "y": 5}
    out, skipped = search.gather({"metadata": m.select("id", "title"), "skd": m.select("id", "title")}, ["query_standards"])
    assert {r.source for r in out.collect()} == {"skd"} and skipped == ["metadata"]
    assert search.holds_words(m, ["title"], "я массив", 10).count() == 2


def test_reports_by_roles(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, None)], "g string, k int, v double")
    p = reports.parameters({"n": 2}, {"n": ("number", None), "day": ("date", "=DATE'2024-01-01'"), "s": ("string", "x")})
    row = df.limit(1).select(*(c.alias(n) for n, c in p.items())).first()
    assert int(row.n) == 2 and row.day.year == 2024 and row.s == "x"
    for given in ({"zzz": 1}, {}):
        with pytest.raises(ValueError):
            reports.parameters(given, {"n": ("number", None)})
    rows = reports.with_roles(reports.calculated(df, {"w": "v * 2", "z": "twice(w)"}, {"twice": lambda x: x * 2}), {"g": "dimension", "z": "resource"})
    assert {r.g: r.z for r in reports.compose(rows).collect()} == {"a": 20.0, "b": None} and reports.fields_of_role(rows, "dimension") == ["g"]
    with pytest.raises(ValueError):
        reports.with_roles(df, {"g": "odd"})


def test_further_sources(spark, tmp_path):
    (tmp_path / "lint.json").write_text(json.dumps({"fileinfos": [{"path": "a.bsl", "diagnostics": [{"code": "X", "severity": "Error", "message": "m", "range": {"start": {"line": 4}}}]}, {"path": "b", "diagnostics": []}]}), encoding="utf-8")
    assert [tuple(r) for r in metadata.scan_linter_report(spark, str(tmp_path / "lint.json")).collect()] == [("a.bsl", 5, "X", "Error", "m")]
    kb = tmp_path / "kb"
    kb.mkdir()
    (kb / "index.json").write_text(json.dumps({"categories": {"patterns": {"items": [{"id": "q", "title": "Т", "file": "patterns/q.md", "keywords": ["запрос"]}]}}}), encoding="utf-8")
    (kb / "q.md").write_text("# Запрос\nтекст", encoding="utf-8")
    r = metadata.scan_knowledge(spark, str(kb)).first()
    assert (r.id, r.category, r.keywords, r.content) == ("q", "patterns", ["запрос"], "# Запрос\nтекст")
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/b.html", "<h1>Метод</h1>")
    (tmp_path / "x.hbk").write_bytes(held.getvalue())
    assert [(r.page, r.html) for r in metadata.scan_help_books(spark, str(tmp_path)).collect()] == [("a/b.html", "<h1>Метод</h1>")]
    (tmp_path / "m/Ext").mkdir(parents=True)
    (tmp_path / "m/Ext/Module.bsl").write_text("А\nБ", encoding="utf-8")
    assert [r.code for r in metadata.scan_modules(spark, str(tmp_path / "m")).collect()] == ["А\nБ"]


def test_duplicates_per_file(spark):
    block = [f"А{i} = {i};" for i in range(6)]
    df = spark.createDataFrame([(1, "\n".join(block * 3)), (2, "\n".join(block)), (3, None), (4, "")], "id int, t string")
    assert [(r.id, r.n) for r in metrics.duplicates_per_file(df, "id", "t").collect()] == [(1, 6)]


def test_stream_parts_survive_a_repeat(spark, data, tmp_path):
    """A batch that is written again replaces its own part."""
    stream = pipelines.event_stream(spark, data, spark.read.parquet(f"{data}/events.parquet").schema)
    first = pipelines.drain(pipelines.deduplicated(stream, "event_id"), str(tmp_path / "d"))
    n = first.count()
    again = pipelines.drain(pipelines.deduplicated(stream, "event_id"), str(tmp_path / "d"))
    assert again.count() == n == spark.read.parquet(f"{data}/events.parquet").select("event_id").distinct().count()


@pytest.mark.parametrize("name", sorted(n for n in queries_code.QUERIES if n.startswith(("source_", "rule_"))))
def test_registered_queries_run(spark, data, name):
    df = queries_code.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0
