"""Logical tables of the query language bound to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import table as load

# fixed values: kinds of tables, Russian and English spelling
KIND_NAMES = """
СПРАВОЧНИК CATALOG | ДОКУМЕНТ DOCUMENT | ПЕРЕЧИСЛЕНИЕ ENUM | КОНСТАНТА CONSTANT | ЖУРНАЛДОКУМЕНТОВ DOCUMENTJOURNAL | ПЛАНВИДОВХАРАКТЕРИСТИК CHARTOFCHARACTERISTICTYPES
ПЛАНСЧЕТОВ CHARTOFACCOUNTS | ПЛАНВИДОВРАСЧЕТА CHARTOFCALCULATIONTYPES | РЕГИСТРСВЕДЕНИЙ INFORMATIONREGISTER | РЕГИСТРНАКОПЛЕНИЯ ACCUMULATIONREGISTER
РЕГИСТРБУХГАЛТЕРИИ ACCOUNTINGREGISTER | РЕГИСТРРАСЧЕТА CALCULATIONREGISTER | БИЗНЕСПРОЦЕСС BUSINESSPROCESS | ЗАДАЧА TASK | ПЛАНОБМЕНА EXCHANGEPLAN
ВНЕШНИЙИСТОЧНИКДАННЫХ EXTERNALDATASOURCE | КРИТЕРИЙОТБОРА FILTERCRITERION | ПОСЛЕДОВАТЕЛЬНОСТЬ SEQUENCE
"""
# fixed values: virtual tables, Russian and English spelling
VIRTUAL_NAMES = """
СРЕЗПОСЛЕДНИХ SLICELAST | СРЕЗПЕРВЫХ SLICEFIRST | ОСТАТКИ BALANCE | ОБОРОТЫ TURNOVERS | ОСТАТКИИОБОРОТЫ BALANCEANDTURNOVERS | ГРАНИЦЫ BOUNDARIES | ОБОРОТЫДТКТ DRCRTURNOVERS
СУБКОНТО EXTDIMENSIONS | ДВИЖЕНИЯССУБКОНТО RECORDSWITHEXTDIMENSIONS | ФАКТИЧЕСКИЙПЕРИОДДЕЙСТВИЯ ACTUALACTIONPERIOD | ДАННЫЕГРАФИКА SCHEDULEDATA | ЗАДАЧИПОИСПОЛНИТЕЛЮ TASKBYPERFORMER
"""
# which registers offer which virtual tables
AVAILABLE = {
    "SLICELAST": ("INFORMATIONREGISTER",), "SLICEFIRST": ("INFORMATIONREGISTER",), "BALANCE": ("ACCUMULATIONREGISTER", "ACCOUNTINGREGISTER"),
    "TURNOVERS": ("ACCUMULATIONREGISTER", "ACCOUNTINGREGISTER"), "BALANCEANDTURNOVERS": ("ACCUMULATIONREGISTER", "ACCOUNTINGREGISTER"), "BOUNDARIES": ("SEQUENCE",),
    "DRCRTURNOVERS": ("ACCOUNTINGREGISTER",), "EXTDIMENSIONS": ("ACCOUNTINGREGISTER",), "RECORDSWITHEXTDIMENSIONS": ("ACCOUNTINGREGISTER",),
    "ACTUALACTIONPERIOD": ("CALCULATIONREGISTER",), "SCHEDULEDATA": ("CALCULATIONREGISTER",), "TASKBYPERFORMER": ("TASK",),
}


def _pairs(text: str) -> dict[str, str]:
    both = [p.split() for line in text.split("\n") for p in line.split("|") if p.strip()]
    return {a: b for a, b in both} | {b: b for _, b in both}


KINDS, VIRTUAL = _pairs(KIND_NAMES), _pairs(VIRTUAL_NAMES) | {"BALANCES": "BALANCE", "BALANCESANDTURNOVERS": "BALANCEANDTURNOVERS"}


@dataclass
class TableDef:
    """One logical table: ``columns`` maps lower-case field names (any language) to physical columns."""

    name: str
    df: DataFrame
    columns: dict[str, str]
    key: str | None = None  # physical column of the reference to a row
    presentation: str | None = None
    refs: dict[str, str] = field(default_factory=dict)  # physical column -> logical table
    parent: str | None = None  # physical column of the parent's key
    dims: list[str] = field(default_factory=list)
    resources: list[str] = field(default_factory=list)
    period: str | None = None
    receipt: Column | None = None
    debit: str | None = None
    credit: str | None = None
    ties: list[str] = field(default_factory=list)
    restriction: Column | str | None = None  # row-level access filter, used by ALLOWED: a column, or a condition in the language
    composites: dict[str, list[str]] = field(default_factory=dict)  # field of several types -> its physical columns, one per type
    numeric: set[str] = field(default_factory=set)
    action: tuple[str, str, str] | None = None  # begin and end of what a record is in force for, and its rank
    schedule: tuple[DataFrame, list[str], str, str] | None = None  # schedule, keys, day, value
    addressing: tuple[DataFrame, list[str], str] | None = None  # addressing register, attributes, performer
    criterion: list[tuple[str, str]] | None = None  # tables and the columns a filter criterion looks at

    @property
    def kind(self) -> str:
        return self.name.split(".")[0]


class Catalog:
    """Case-insensitive, bilingual look-up of logical tables."""

    def __init__(self) -> None:
        self.tables: dict[str, TableDef] = {}

    def add(self, t: TableDef, *aliases: str) -> None:
        for n in (t.name, *aliases):
            self.tables[self.normal(n.split("."))] = t

    @staticmethod
    def normal(parts: list[str]) -> str:
        upper = [p.upper() for p in parts]
        return ".".join([KINDS.get(upper[0], upper[0]), *upper[1:]])

    def find(self, parts: list[str]) -> tuple[TableDef, str | None] | None:
        """The table a path names, with the virtual table behind it if there is one."""
        whole = self.tables.get(self.normal(parts))
        if whole:
            return whole, None
        if len(parts) == 3 and (base := self.tables.get(self.normal(parts[:2]))):
            return base, VIRTUAL.get(parts[2].upper(), "?" + parts[2])
        return None


def _columns(df: DataFrame, names: dict[str, str]) -> dict[str, str]:
    """Physical names and their aliases ('English Russian' words) in lower case."""
    out = {c.lower(): c for c in df.columns}
    for physical, words in names.items():
        out |= {w.lower(): physical for w in words.split()}
    return out


def sample_catalog(spark: SparkSession, d: str) -> Catalog:
    """The star-schema test tables as an ERP configuration."""
    c = Catalog()
    t = {n: load(spark, d, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    c.add(TableDef("Catalog.Regions", t["region"], _columns(t["region"], {"r_regionkey": "Ref Ссылка", "r_name": "Description Наименование"}), "r_regionkey", "r_name"), "Catalog.Регионы")
    c.add(
        TableDef("Catalog.Nations", t["nation"], _columns(t["nation"], {"n_nationkey": "Ref Ссылка", "n_name": "Description Наименование", "n_regionkey": "Region Регион"}), "n_nationkey", "n_name", {"n_regionkey": "Catalog.Regions"}),
        "Catalog.Страны",
    )
    c.add(
        TableDef("Catalog.Customers", t["customer"], _columns(t["customer"], {"c_custkey": "Ref Ссылка", "c_name": "Description Наименование", "c_nationkey": "Nation Страна", "c_acctbal": "Balance Сальдо", "c_mktsegment": "Segment Сегмент"}), "c_custkey", "c_name", {"c_nationkey": "Catalog.Nations"}, restriction=F.col("c_acctbal") >= 0),
        "Catalog.Покупатели",
    )
    c.add(
        TableDef("Catalog.Suppliers", t["supplier"], _columns(t["supplier"], {"s_suppkey": "Ref Ссылка", "s_name": "Description Наименование", "s_nationkey": "Nation Страна", "s_acctbal": "Balance Сальдо"}), "s_suppkey", "s_name", {"s_nationkey": "Catalog.Nations"}),
        "Catalog.Поставщики",
    )
    c.add(
        TableDef("Catalog.Parts", t["part"], _columns(t["part"], {"p_partkey": "Ref Ссылка", "p_name": "Description Наименование", "p_brand": "Brand Марка", "p_type": "Kind Вид", "p_size": "Size Размер", "p_retailprice": "Price Цена"}), "p_partkey", "p_name"),
        "Catalog.Товары",
    )
    geo = (
        t["region"].select(F.concat(F.lit("R"), "r_regionkey").alias("ref"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("description"))
        .unionByName(t["nation"].select(F.concat(F.lit("N"), "n_nationkey").alias("ref"), F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.col("n_name").alias("description")))
        .unionByName(t["customer"].select(F.concat(F.lit("C"), "c_custkey").alias("ref"), F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.col("c_name").alias("description")))
    )
    c.add(TableDef("Catalog.Geography", geo, _columns(geo, {"ref": "Ссылка", "parent": "Родитель", "description": "Наименование"}), "ref", "description", {"parent": "Catalog.Geography"}, "parent"), "Catalog.География")
    c.add(
        TableDef("Document.Orders", t["orders"], _columns(t["orders"], {"o_orderkey": "Ref Ссылка Number Номер", "o_custkey": "Customer Покупатель", "o_orderstatus": "Status Статус", "o_totalprice": "Total Итого", "o_orderdate": "Date Дата", "o_orderpriority": "Priority Приоритет"}), "o_orderkey", "o_orderpriority", {"o_custkey": "Catalog.Customers"}),
        "Document.Заказы",
    )
    line = {"l_orderkey": "Ref Ссылка Order Заказ", "l_linenumber": "LineNumber НомерСтроки", "l_partkey": "Part Товар", "l_suppkey": "Supplier Поставщик", "l_quantity": "Quantity Количество", "l_extendedprice": "Amount Сумма", "l_discount": "Discount Скидка", "l_tax": "Tax Налог", "l_returnflag": "ReturnFlag Возврат", "l_linestatus": "LineStatus", "l_shipdate": "Period Период ShipDate ДатаОтгрузки"}
    refs = {"l_orderkey": "Document.Orders", "l_partkey": "Catalog.Parts", "l_suppkey": "Catalog.Suppliers"}
    lines = _columns(t["lineitem"], line)
    c.add(TableDef("Document.Orders.Lines", t["lineitem"], lines, None, None, refs), "Document.Заказы.Строки")
    common = dict(columns=lines, refs=refs, resources=["l_quantity", "l_extendedprice"], period="l_shipdate")
    c.add(TableDef("AccumulationRegister.Stock", t["lineitem"], dims=["l_partkey", "l_suppkey"], receipt=F.col("l_linestatus") == "F", **common), "AccumulationRegister.Запасы")
    c.add(TableDef("AccumulationRegister.Sales", t["lineitem"], dims=["l_partkey", "l_suppkey", "l_orderkey"], **common), "AccumulationRegister.Продажи")
    c.add(TableDef("AccountingRegister.Journal", t["lineitem"], dims=["l_returnflag"], debit="l_suppkey", credit="l_partkey", **common), "AccountingRegister.Хозрасчетный")
    c.add(TableDef("Sequence.Orders", t["orders"], _columns(t["orders"], {"o_orderdate": "Period Период"}), dims=["o_custkey"], period="o_orderdate"))
    c.add(
        TableDef("InformationRegister.UserEvents", t["events"], _columns(t["events"], {"ts": "Period Период", "user_id": "User Пользователь", "event_type": "EventType ВидСобытия", "value": "Value Значение"}), dims=["user_id", "event_type"], resources=["value"], period="ts", ties=["event_id"]),
        "InformationRegister.События",
    )
    owners = t["customer"].select(F.col("c_name").alias("contact"), F.col("c_custkey").alias("owner_customer"), F.lit(None).cast("bigint").alias("owner_supplier")).unionByName(
        t["supplier"].select(F.col("s_name").alias("contact"), F.lit(None).cast("bigint").alias("owner_customer"), F.col("s_suppkey").alias("owner_supplier"))
    )
    c.add(
        TableDef("InformationRegister.Contacts", owners, _columns(owners, {"contact": "Контакт"}), refs={"owner_customer": "Catalog.Customers", "owner_supplier": "Catalog.Suppliers"}, composites={"owner": ["owner_customer", "owner_supplier"], "владелец": ["owner_customer", "owner_supplier"]}, restriction="ГДЕ Владелец.Сальдо > &Порог"),
        "InformationRegister.Контакты",
    )
    # the orders as records of a calculation register: each is in force for as many days as its priority says
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    charges = t["orders"].select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("begin"), F.timestamp_add("DAY", rank * 30, F.col("o_orderdate")).alias("end"), "o_orderkey", rank.alias("rank")).toDF("charge", "employee", "begin", "end", "number", "rank")
    days = t["orders"].groupBy(F.col("o_custkey").alias("employee"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.sum(F.lit(8.0)).alias("hours"))
    c.add(
        TableDef("CalculationRegister.Charges", charges, _columns(charges, {"employee": "Сотрудник", "charge": "Начисление"}), dims=["employee"], period="begin", action=("begin", "end", "number"), schedule=(days, ["employee"], "day", "hours")),
        "CalculationRegister.Начисления",
    )
    tasks = t["supplier"].select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("office"), F.col("s_name").alias("title"))
    who = t["nation"].select(F.when(F.col("n_nationkey") < 20, F.col("n_nationkey")).alias("office"), F.concat(F.lit("user"), F.col("n_regionkey").cast("string")).alias("person"))
    c.add(TableDef("Task.Errands", tasks, _columns(tasks, {"task": "Ref Ссылка", "title": "Description Наименование"}), "task", "title", addressing=(who, ["office"], "person")), "Task.Поручения")
    c.add(TableDef("ExternalDataSource.Warehouse.Table.Parts", t["part"], _columns(t["part"], {"p_partkey": "Ref Ссылка"}), "p_partkey", "p_name"))
    c.add(TableDef("FilterCriterion.OfNation", t["nation"], {}, criterion=[("Catalog.Customers", "c_nationkey"), ("Catalog.Suppliers", "s_nationkey")]), "FilterCriterion.ПоСтране")
    return c
