"""Templates, workflow, command line, registry and contracts."""

import datetime as dt
import json

import pytest

from ledgerloom import cli, contracts
from ledgerloom.functions.text import words_column
from ledgerloom.operators import code, search
from ledgerloom.plans import validator, workflow
from ledgerloom.plans.catalog import sample_catalog
from ledgerloom.plans.parser import parse
from ledgerloom.sources import metadata, sinks


def test_every_template_parses():
    values = dict(table="РегистрНакопления.Запасы", group="Товар", resource="Количество", field="Товар", fields="Т.Товар КАК Товар", n="5", other="Справочник.Товары")
    assert len(validator.TEMPLATES) == 16 and len({t[0] for t in validator.TEMPLATES}) == 16
    for name, _, text in validator.TEMPLATES:
        assert parse(validator.fill_template(name, **{k: v for k, v in values.items() if "{" + k + "}" in text}))


def test_workflow(spark, data):
    catalog = sample_catalog(spark, data)
    flow = workflow.run("покажи остатки запасов на складе", catalog, spark)
    assert flow.template == "balance" and flow.valid and flow.explanation["virtual_tables"] == ["Остатки"] and "AccumulationRegister.Stock" in flow.text
    own = workflow.run("ВЫБРАТЬ * ИЗ Справочник.Нет КАК Т", catalog, spark)
    assert not own.valid and own.template is None and ("Q001", "all fields selected") in own.advice
    assert workflow.run("SELECT (", catalog, spark).explanation == {}


def test_command_line(spark, data, capsys):
    said = lambda: json.loads(capsys.readouterr().out)
    assert cli.main(["query", "templates"]) == 0 and "balance" in said()
    assert cli.main(["query", "explain", "SELECT R.Ref AS a FROM Catalog.Regions AS R"]) == 0 and said()["tables"] == ["Catalog.Regions"]
    assert cli.main(["query", "validate", "SELECT R.Zzz AS a FROM Catalog.Regions AS R", "--data", data], spark) == 1 and said()[0]["code"] == "FIELD_NOT_FOUND"
    assert cli.main(["query", "gen", "топ 7 продаж", "--data", data], spark) == 0 and "ПЕРВЫЕ 7" in said()["text"]
    assert cli.main(["query", "optimize", "SELECT * FROM T", "--data", data], spark) == 0 and ["Q001", "all fields selected"] in said()
    assert cli.main(["query", "run", "SELECT R.Description AS d FROM Catalog.Regions AS R", "--data", data], spark) == 0 and "ASIA" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["query", "nothing"])


def test_registry_and_freshness(spark, tmp_path):
    at = str(tmp_path / "registry")
    for name, path in (("a", "/1"), ("b", "/2"), ("a", "/3")):
        sinks.registry_put(spark, at, name, path)
    sinks.registry_remove(spark, at, "b")
    assert [tuple(r) for r in sinks.registry_list(spark, at).collect()] == [("a", "/3")]
    t = dt.datetime
    schema = "path string, length long, modificationTime timestamp"
    now = spark.createDataFrame([("a", 1, t(2024, 1, 1)), ("b", 2, t(2024, 1, 2)), ("c", 3, t(2024, 1, 1))], schema)
    then = spark.createDataFrame([("a", 1, t(2024, 1, 1)), ("b", 2, t(2024, 1, 1)), ("d", 3, t(2024, 1, 1))], schema)
    assert {tuple(r) for r in sinks.stale_files(now, then).collect()} == {("b", "changed"), ("c", "new"), ("d", "gone")}


def test_contracts(spark):
    docs = spark.createDataFrame([(1, "a")], "id int, t string")
    index = search.TextIndex.build(docs, "id", words_column(docs.t))
    assert isinstance(index, contracts.Searcher) and isinstance(words_column, contracts.Tokenizer) and isinstance(validator.validate, contracts.QueryValidator)
    assert isinstance(code.methods_of, contracts.SourceReader) and isinstance(metadata.scan_objects, contracts.MetadataReader)
