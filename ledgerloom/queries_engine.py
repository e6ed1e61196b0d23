"""Queries in the bilingual query language, run by the engine over the star-schema tables, with their SQL oracles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.builder import Engine
from ledgerloom.plans.catalog import sample_catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TEXTS: dict[str, str] = {}


def q(name: str, text: str, sql: str | None = None, shown: Callable[[DataFrame], DataFrame] | None = None, **params: Any) -> None:
    """Register a query text and its oracle; ``shown`` gives the result a form SQL can be compared in."""
    TEXTS[name] = text

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = Engine(spark, sample_catalog(spark, d)).run(text, params)
        return df if shown is None else shown(df)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


D = dt.datetime

q("rel_select_filter_project",
  "ВЫБРАТЬ Т.Ссылка КАК key, Т.Наименование КАК name, Т.Цена * 2 КАК twice ИЗ Справочник.Товары КАК Т ГДЕ Т.Размер > 25 И НЕ Т.Марка = &Марка",
  "SELECT p_partkey AS key, p_name AS name, p_retailprice * 2 AS twice FROM part WHERE p_size > 25 AND p_brand <> 'Brand#11'", Марка="Brand#11")
q("rel_distinct", "SELECT DISTINCT N.Region AS region FROM Catalog.Nations AS N", "SELECT DISTINCT n_regionkey AS region FROM nation")
q("rel_top", "SELECT TOP 10 P.Ref AS key, P.Price AS price FROM Catalog.Parts AS P ORDER BY price DESC, key", "SELECT p_partkey AS key, p_retailprice AS price FROM part ORDER BY price DESC, key LIMIT 10")
q("rel_case_cast",
  'SELECT O.Ref AS key, CASE WHEN O.Total > 200000 THEN "big" WHEN O.Total > 100000 THEN "mid" ELSE "small" END AS size, CAST(O.Total AS NUMBER(15,1)) AS total, CAST(O.Priority AS STRING(3)) AS pri FROM Document.Orders AS O',
  "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size, CAST(o_totalprice AS DECIMAL(15,1)) AS total, substr(o_orderpriority,1,3) AS pri FROM orders")
q("rel_simple_case", "SELECT O.Ref AS key, CASE O.Status WHEN \"F\" THEN 1 WHEN \"O\" THEN 2 ELSE 3 END AS code FROM Document.Orders AS O", "SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
q("rel_like_escape", 'SELECT P.Ref AS key FROM Catalog.Parts AS P WHERE P.Brand LIKE "Brand##1%" ESCAPE "#"', "SELECT p_partkey AS key FROM part WHERE p_brand LIKE 'Brand##1%' ESCAPE '#'")
q("rel_like_class", 'SELECT P.Ref AS key FROM Catalog.Parts AS P WHERE P.Brand ПОДОБНО "%[1-3]"', "SELECT p_partkey AS key FROM part WHERE regexp_matches(p_brand, '[1-3]$')")
q("rel_between_in", "SELECT P.Ref AS key FROM Catalog.Parts AS P WHERE P.Size BETWEEN 5 AND 15 AND P.Size IN (5, 7, 9, 11)", "SELECT p_partkey AS key FROM part WHERE p_size BETWEEN 5 AND 15 AND p_size IN (5,7,9,11)")
q("rel_param_list_in", "SELECT N.Ref AS key FROM Catalog.Nations AS N WHERE N.Ref IN (&List)", "SELECT n_nationkey AS key FROM nation WHERE n_nationkey IN (1,3,5,7)", List=[1, 3, 5, 7])
q("rel_is_null_coalesce", "SELECT C.Ref AS key, ISNULL(O.Total, 0) AS total FROM Catalog.Customers AS C LEFT JOIN Document.Orders AS O ON C.Ref = O.Customer WHERE O.Total IS NULL OR O.Total > 300000",
  "SELECT c_custkey AS key, coalesce(o_totalprice, 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice IS NULL OR o_totalprice > 300000")
q("rel_in_subquery_semi", "SELECT C.Ref AS key FROM Catalog.Customers AS C WHERE C.Ref IN (SELECT O.Customer FROM Document.Orders AS O WHERE O.Total > 250000)", "SELECT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
q("rel_tuple_in", "SELECT L.Order AS ord, L.LineNumber AS line FROM Document.Orders.Lines AS L WHERE (L.Order, L.Part) IN (SELECT X.Order, MIN(X.Part) FROM Document.Orders.Lines AS X GROUP BY X.Order)",
  "SELECT l_orderkey AS ord, l_linenumber AS line FROM lineitem WHERE (l_orderkey, l_partkey) IN (SELECT l_orderkey, min(l_partkey) FROM lineitem GROUP BY 1)")
q("rel_not_in_anti", "SELECT C.Ref AS key FROM Catalog.Customers AS C WHERE C.Ref NOT IN (SELECT O.Customer FROM Document.Orders AS O)", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("rel_left_join_null_anti", "SELECT C.Ref AS key FROM Catalog.Customers AS C LEFT OUTER JOIN Document.Orders AS O ON O.Customer = C.Ref WHERE O.Ref IS NULL", "SELECT c_custkey AS key FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
q("rel_inner_join", "ВЫБРАТЬ П.Наименование КАК name, С.Наименование КАК nation ИЗ Справочник.Поставщики КАК П ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Страны КАК С ПО П.Страна = С.Ссылка", "SELECT s_name AS name, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
q("rel_right_join", "SELECT N.Description AS nation, S.Ref AS key FROM Catalog.Suppliers AS S RIGHT JOIN Catalog.Nations AS N ON S.Nation = N.Ref", "SELECT n_name AS nation, s_suppkey AS key FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
q("rel_full_join", "SELECT S.Ref AS s, C.Ref AS c FROM Catalog.Suppliers AS S FULL JOIN Catalog.Customers AS C ON S.Ref = C.Ref AND S.Nation = C.Nation", "SELECT s_suppkey AS s, c_custkey AS c FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
q("rel_cross_comma", "SELECT R.Description AS region, N.Description AS nation FROM Catalog.Regions AS R, Catalog.Nations AS N WHERE R.Ref = N.Region", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE r_regionkey = n_regionkey")
q("rel_nested_join", "SELECT S.Ref AS key, R.Description AS region FROM Catalog.Suppliers AS S JOIN (Catalog.Nations AS N JOIN Catalog.Regions AS R ON N.Region = R.Ref) ON S.Nation = N.Ref", "SELECT s_suppkey AS key, r_name AS region FROM supplier JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey")
q("rel_or_join", "SELECT C.Ref AS c, S.Ref AS s FROM Catalog.Customers AS C JOIN Catalog.Suppliers AS S ON C.Ref = S.Ref OR C.Ref = S.Nation", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_custkey = s_nationkey")
q("rel_theta_range_join", "SELECT R.Ref AS r, N.Ref AS n FROM Catalog.Regions AS R JOIN Catalog.Nations AS N ON N.Ref BETWEEN R.Ref * 3 AND R.Ref * 5", "SELECT r_regionkey AS r, n_nationkey AS n FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey*3 AND r_regionkey*5")
q("rel_composite_key_join", "SELECT L.Order AS ord, L.LineNumber AS line, K.n AS n FROM Document.Orders.Lines AS L JOIN (SELECT X.Order AS ord, X.LineNumber AS line, COUNT(*) AS n FROM Document.Orders.Lines AS X GROUP BY X.Order, X.LineNumber) AS K ON L.Order = K.ord AND L.LineNumber = K.line WHERE K.n > 1",
  "SELECT l_orderkey AS ord, l_linenumber AS line, n FROM lineitem JOIN (SELECT l_orderkey o, l_linenumber l, count(*) n FROM lineitem GROUP BY 1,2) k ON l_orderkey = o AND l_linenumber = l WHERE n > 1")
q("rel_deref_one_hop", "SELECT O.Ref AS key, O.Customer.Segment AS segment FROM Document.Orders AS O", "SELECT o_orderkey AS key, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
q("rel_deref_three_hop", "ВЫБРАТЬ З.Покупатель.Страна.Регион.Наименование КАК region, ОКР(СУММА(З.Итого), 2) КАК total ИЗ Документ.Заказы КАК З СГРУППИРОВАТЬ ПО З.Покупатель.Страна.Регион.Наименование",
  "SELECT r_name AS region, round(sum(o_totalprice),2) AS total FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey GROUP BY 1")
q("rel_composite_cast_deref", "SELECT O.Ref AS key, CAST(O.Customer AS Catalog.Customers).Description AS name FROM Document.Orders AS O WHERE O.Customer REFS Catalog.Customers", "SELECT o_orderkey AS key, c_name AS name FROM orders LEFT JOIN customer ON o_custkey=c_custkey WHERE o_custkey IS NOT NULL")
q("rel_presentation", "SELECT O.Ref AS key, PRESENTATION(O.Customer) AS who FROM Document.Orders AS O", "SELECT o_orderkey AS key, c_name AS who FROM orders LEFT JOIN customer ON o_custkey=c_custkey")
q("rel_scalar_subquery", "SELECT P.Ref AS key FROM Catalog.Parts AS P WHERE P.Price > (SELECT AVG(X.Price) FROM Catalog.Parts AS X)", "SELECT p_partkey AS key FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
q("rel_correlated_subquery", "SELECT C.Ref AS key, (SELECT MAX(O.Total) FROM Document.Orders AS O WHERE O.Customer = C.Ref) AS best FROM Catalog.Customers AS C", "SELECT c_custkey AS key, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
q("rel_from_subquery_agg", "SELECT T.segment AS segment, COUNT(*) AS n FROM (SELECT C.Segment AS segment, C.Ref AS ref FROM Catalog.Customers AS C WHERE C.Balance > 0) AS T GROUP BY T.segment", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
q("rel_union_all", "SELECT C.Ref AS key FROM Catalog.Customers AS C UNION ALL SELECT S.Ref FROM Catalog.Suppliers AS S", "SELECT c_custkey AS key FROM customer UNION ALL SELECT s_suppkey FROM supplier")
q("rel_union_distinct", "SELECT C.Nation AS key FROM Catalog.Customers AS C UNION SELECT S.Nation FROM Catalog.Suppliers AS S ORDER BY key", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
q("rel_temp_table_batch",
  "ВЫБРАТЬ З.Покупатель КАК cust, СУММА(З.Итого) КАК total ПОМЕСТИТЬ ВТ_Суммы ИЗ Документ.Заказы КАК З СГРУППИРОВАТЬ ПО З.Покупатель ИНДЕКСИРОВАТЬ ПО cust;\nВЫБРАТЬ П.Наименование КАК name, ОКР(В.total, 2) КАК total ИЗ ВТ_Суммы КАК В ВНУТРЕННЕЕ СОЕДИНЕНИЕ Справочник.Покупатели КАК П ПО В.cust = П.Ссылка ГДЕ В.total > 500000;\nУНИЧТОЖИТЬ ВТ_Суммы",
  "SELECT c_name AS name, round(total,2) AS total FROM (SELECT o_custkey, sum(o_totalprice) total FROM orders GROUP BY 1) JOIN customer ON o_custkey=c_custkey WHERE total > 500000")
q("rel_temp_table_add", "SELECT C.Ref AS key INTO T FROM Catalog.Customers AS C; SELECT S.Ref AS key ADD T FROM Catalog.Suppliers AS S; SELECT COUNT(*) AS n FROM T AS T", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n")
q("rel_allowed", "SELECT ALLOWED C.Ref AS key FROM Catalog.Customers AS C", "SELECT c_custkey AS key FROM customer WHERE c_acctbal >= 0")
q("rel_value_literal", 'SELECT N.Ref AS key FROM Catalog.Nations AS N WHERE N.Region = VALUE(Catalog.Regions.ASIA)', "SELECT n_nationkey AS key FROM nation WHERE n_regionkey = (SELECT min(r_regionkey) FROM region WHERE r_name='ASIA')")
q("rel_record_number", "SELECT N.Ref AS key, RECORDAUTONUMBER() AS num FROM Catalog.Nations AS N", "SELECT n_nationkey AS key, row_number() OVER (ORDER BY n_nationkey) - 1 AS num FROM nation")
q("rel_string_concat", 'SELECT C.Ref AS key, C.Description + " / " + C.Segment AS label FROM Catalog.Customers AS C', "SELECT c_custkey AS key, c_name || ' / ' || c_mktsegment AS label FROM customer")
q("rel_star", "SELECT * FROM Catalog.Regions AS R", "SELECT * FROM region")
q("rel_having", "SELECT O.Customer AS cust, COUNT(*) AS n FROM Document.Orders AS O GROUP BY O.Customer HAVING COUNT(*) > 12", "SELECT o_custkey AS cust, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")

q("agg_sum_avg_min_max", "SELECT L.ReturnFlag AS flag, ROUND(SUM(L.Amount), 2) AS s, ROUND(AVG(L.Quantity), 4) AS a, MIN(L.Discount) AS lo, MAX(L.Tax) AS hi, COUNT(L.Part) AS n FROM Document.Orders.Lines AS L GROUP BY L.ReturnFlag",
  "SELECT l_returnflag AS flag, round(sum(l_extendedprice),2) AS s, round(avg(l_quantity),4) AS a, min(l_discount) AS lo, max(l_tax) AS hi, count(l_partkey) AS n FROM lineitem GROUP BY 1")
q("agg_count_distinct", "SELECT L.LineStatus AS status, COUNT(DISTINCT L.Part) AS parts FROM Document.Orders.Lines AS L GROUP BY L.LineStatus", "SELECT l_linestatus AS status, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
q("agg_sum_distinct", "SELECT SUM(DISTINCT P.Size) AS s FROM Catalog.Parts AS P", "SELECT sum(DISTINCT p_size)::BIGINT AS s FROM part")
q("agg_grouping_sets", "SELECT L.ReturnFlag AS flag, L.LineStatus AS status, COUNT(*) AS n FROM Document.Orders.Lines AS L GROUP BY GROUPING SETS ((L.ReturnFlag, L.LineStatus), (L.ReturnFlag), ())", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag,l_linestatus),(l_returnflag),())")
q("agg_groupedby_flag", "SELECT L.ReturnFlag AS flag, GROUPEDBY(L.ReturnFlag) AS used, COUNT(*) AS n FROM Document.Orders.Lines AS L GROUP BY GROUPING SETS ((L.ReturnFlag), ())", "SELECT l_returnflag AS flag, (1 - grouping(l_returnflag))::INTEGER AS used, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag),())")
q("agg_totals", "SELECT O.Status AS status, O.Priority AS priority, COUNT(*) AS n FROM Document.Orders AS O GROUP BY O.Status, O.Priority TOTALS SUM(n) BY OVERALL, status",
  "WITH d AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1,2) SELECT status, priority, n, NULL::BIGINT AS totals_level FROM d UNION ALL SELECT status, NULL, sum(n)::BIGINT, 1 FROM d GROUP BY status UNION ALL SELECT NULL, NULL, sum(n)::BIGINT, 0 FROM d")
q("agg_totals_periods", "SELECT BEGINOFPERIOD(E.Period, DAY) AS day, COUNT(*) AS n FROM InformationRegister.UserEvents AS E WHERE E.EventType = \"error\" AND E.Period >= &From GROUP BY BEGINOFPERIOD(E.Period, DAY) TOTALS SUM(n) BY day PERIODS(DAY, &From, &To)",
  "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events WHERE event_type='error' AND ts >= TIMESTAMP '2024-01-10' GROUP BY 1), t AS (SELECT day, sum(n)::BIGINT AS n FROM d GROUP BY 1), p AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS day) SELECT day, n, NULL::BIGINT AS totals_level FROM d UNION ALL SELECT p.day, t.n, 1 FROM p LEFT JOIN t ON t.day = p.day UNION ALL SELECT t.day, t.n, 1 FROM t WHERE t.day NOT IN (SELECT day FROM p)",
  From=D(2024, 1, 10), To=D(2024, 2, 5))

q("fn_string", 'SELECT C.Ref AS key, SUBSTRING(C.Description, 3, 4) AS sub, UPPER(C.Segment) AS up, LOWER(C.Segment) AS low, STRINGLENGTH(C.Description) AS len, LEFT(C.Description, 3) AS l, RIGHT(C.Description, 3) AS r, STRFIND(C.Segment, "U") AS pos, STRREPLACE(C.Segment, "U", "u") AS rep, TRIMALL("  x ") AS tr FROM Catalog.Customers AS C',
  "SELECT c_custkey AS key, substr(c_name,3,4) AS sub, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, length(c_name) AS len, left(c_name,3) AS l, right(c_name,3) AS r, instr(c_mktsegment,'U') AS pos, replace(c_mktsegment,'U','u') AS rep, 'x' AS tr FROM customer")
q("fn_date_parts", "SELECT E.event_id AS key, YEAR(E.Period) AS y, QUARTER(E.Period) AS q, MONTH(E.Period) AS m, DAYOFYEAR(E.Period) AS doy, DAY(E.Period) AS d, WEEK(E.Period) AS w, WEEKDAY(E.Period) AS wd, HOUR(E.Period) AS h, MINUTE(E.Period) AS mi, SECOND(E.Period) AS s FROM InformationRegister.UserEvents AS E",
  "SELECT event_id AS key, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, dayofyear(ts) AS doy, day(ts) AS d, weekofyear(ts) AS w, isodow(ts) AS wd, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")
q("fn_begin_end_of_period", "SELECT O.Ref AS key, BEGINOFPERIOD(O.Date, MONTH) AS bm, ENDOFPERIOD(O.Date, QUARTER) AS eq, BEGINOFPERIOD(O.Date, TENDAYS) AS bt, ENDOFPERIOD(O.Date, TENDAYS) AS et, BEGINOFPERIOD(O.Date, HALFYEAR) AS bh, ENDOFPERIOD(O.Date, HALFYEAR) AS eh, BEGINOFPERIOD(O.Date, WEEK) AS bw FROM Document.Orders AS O",
  "SELECT o_orderkey AS key, date_trunc('month',o_orderdate)::TIMESTAMP AS bm, (date_trunc('quarter',o_orderdate)::TIMESTAMP + INTERVAL 3 MONTH - INTERVAL 1 SECOND) AS eq, date_trunc('month',o_orderdate)::TIMESTAMP + INTERVAL 1 DAY * (10*least((day(o_orderdate)-1)//10,2)) AS bt, CASE WHEN day(o_orderdate)>20 THEN date_trunc('month',o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH ELSE date_trunc('month',o_orderdate)::TIMESTAMP + INTERVAL 1 DAY * (10*((day(o_orderdate)-1)//10)+10) END - INTERVAL 1 SECOND AS et, date_trunc('year',o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH * (CASE WHEN month(o_orderdate)>6 THEN 6 ELSE 0 END) AS bh, date_trunc('year',o_orderdate)::TIMESTAMP + INTERVAL 1 MONTH * (CASE WHEN month(o_orderdate)>6 THEN 12 ELSE 6 END) - INTERVAL 1 SECOND AS eh, date_trunc('week',o_orderdate)::TIMESTAMP AS bw FROM orders")
q("fn_dateadd_datediff", "SELECT O.Ref AS key, DATEADD(O.Date, MONTH, 1) AS am, DATEADD(O.Date, TENDAYS, 2) AS at2, DATEDIFF(O.Date, DATETIME(1999, 1, 1), MONTH) AS dm, DATEDIFF(O.Date, DATETIME(1999, 1, 1), YEAR) AS dy, DATEDIFF(O.Date, DATETIME(1999, 1, 1), DAY) AS dd FROM Document.Orders AS O",
  "SELECT o_orderkey AS key, o_orderdate + INTERVAL 1 MONTH AS am, o_orderdate + INTERVAL 20 DAY AS at2, date_diff('month', o_orderdate, TIMESTAMP '1999-01-01') AS dm, date_diff('year', o_orderdate, TIMESTAMP '1999-01-01') AS dy, date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS dd FROM orders")
q("fn_math", "SELECT P.Ref AS key, ROUND(SQRT(P.Size), 6) AS sq, ROUND(LOG(P.Size), 6) AS ln, ROUND(LOG10(P.Size), 6) AS lg, ROUND(EXP(P.Size / 50), 6) AS ex, ROUND(POW(P.Size, 2), 2) AS pw, ROUND(SIN(P.Size), 6) AS sn, ROUND(COS(P.Size), 6) AS cs, ROUND(ATAN(P.Size), 6) AS an FROM Catalog.Parts AS P",
  "SELECT p_partkey AS key, round(sqrt(p_size),6) AS sq, round(ln(p_size),6) AS ln, round(log10(p_size),6) AS lg, round(exp(p_size/50.0::DOUBLE),6) AS ex, round(pow(p_size,2),2) AS pw, round(sin(p_size),6) AS sn, round(cos(p_size),6) AS cs, round(atan(p_size),6) AS an FROM part")
q("fn_round_int", "SELECT P.Ref AS key, ROUND(P.Price, 1) AS r1, INT(P.Price) AS i, P.Size / 4 AS quarter, -P.Size AS neg FROM Catalog.Parts AS P", "SELECT p_partkey AS key, round(p_retailprice,1) AS r1, trunc(p_retailprice)::BIGINT AS i, p_size / 4 AS quarter, -p_size AS neg FROM part")

q("vt_slice_last", "SELECT S.User AS u, S.EventType AS t, S.Period AS p, S.event_id AS id FROM InformationRegister.UserEvents.SliceLast(&At, EventType IN (\"view\", \"purchase\")) AS S",
  "SELECT user_id AS u, event_type AS t, ts AS p, event_id AS id FROM events WHERE event_type IN ('view','purchase') AND ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1", At=D(2024, 1, 20))
q("vt_slice_first", "ВЫБРАТЬ С.Пользователь КАК u, С.ВидСобытия КАК t, С.Период КАК p ИЗ РегистрСведений.События.СрезПервых(&С) КАК С",
  "SELECT user_id AS u, event_type AS t, ts AS p FROM events WHERE ts >= TIMESTAMP '2024-01-05' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", С=D(2024, 1, 5))
_BT = "WITH c AS (SELECT l_partkey AS part, l_suppkey AS supp, CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN NULL ELSE date_trunc('quarter', l_shipdate)::TIMESTAMP END AS p, l_shipdate < TIMESTAMP '1995-01-01' AS before, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE -l_quantity END) n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-12-31' GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY part, supp ORDER BY before DESC, p ROWS UNBOUNDED PRECEDING) cl FROM c) SELECT part, supp, p AS quarter, round(cl - n, 2) AS opening, round(n, 2) AS net, round(cl, 2) AS closing FROM w WHERE NOT before"
q("vt_balance", "ВЫБРАТЬ О.Товар КАК part, О.Поставщик КАК supp, ОКР(О.КоличествоОстаток, 2) КАК qty ИЗ РегистрНакопления.Запасы.Остатки(&На) КАК О", "WITH b AS (SELECT l_partkey AS part, l_suppkey AS supp, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE -l_quantity END) AS q, sum(CASE WHEN l_linestatus='F' THEN l_extendedprice ELSE -l_extendedprice END) AS a FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1,2) SELECT part, supp, round(q,2) AS qty FROM b WHERE q <> 0 OR a <> 0", На=D(1997, 1, 1))
q("vt_turnovers_monthly", "SELECT T.Part AS part, T.Period AS month, ROUND(T.QuantityReceipt, 2) AS got, ROUND(T.QuantityExpense, 2) AS gone, ROUND(T.QuantityTurnover, 2) AS net FROM AccumulationRegister.Stock.Turnovers(&B, &E, MONTH) AS T",
  "SELECT part, month, round(g,2) AS got, round(x,2) AS gone, round(n,2) AS net FROM (SELECT l_partkey AS part, l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS month, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE 0 END) g, sum(CASE WHEN l_linestatus='F' THEN 0 ELSE l_quantity END) x, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE -l_quantity END) n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31' GROUP BY 1,2,3)", B=D(1995, 1, 1), E=D(1995, 12, 31))
q("vt_balance_and_turnovers", "SELECT T.Part AS part, T.Supplier AS supp, T.Period AS quarter, ROUND(T.QuantityOpening, 2) AS opening, ROUND(T.QuantityTurnover, 2) AS net, ROUND(T.QuantityClosing, 2) AS closing FROM AccumulationRegister.Stock.BalanceAndTurnovers(&B, &E, QUARTER) AS T",
  _BT, B=D(1995, 1, 1), E=D(1996, 12, 31))
q("vt_drcr_turnovers", "SELECT T.AccountDr AS dr, T.AccountCr AS cr, T.ReturnFlag AS flag, ROUND(T.AmountTurnover, 2) AS amount FROM AccountingRegister.Journal.DrCrTurnovers(&B, &E) AS T", "SELECT l_suppkey AS dr, l_partkey AS cr, l_returnflag AS flag, round(sum(l_extendedprice),2) AS amount FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1,2,3", B=D(1995, 1, 1), E=D(1996, 12, 31))
q("vt_boundaries", "SELECT B.o_custkey AS cust, B.Period AS last FROM Sequence.Orders.Boundaries() AS B", "SELECT o_custkey AS cust, max(o_orderdate) AS last FROM orders GROUP BY 1")
q("vt_ext_dimensions", "SELECT X.kind AS kind, COUNT(DISTINCT X.value) AS n FROM AccountingRegister.Journal.ExtDimensions() AS X GROUP BY X.kind", "SELECT 'l_suppkey' AS kind, count(DISTINCT l_suppkey) AS n FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem")
q("vt_asof_lookup", "SELECT E.event_id AS id, S.Value AS known FROM InformationRegister.UserEvents AS E LEFT JOIN InformationRegister.UserEvents.SliceLast(&At, EventType = \"signup\") AS S ON E.User = S.User WHERE E.EventType = \"error\"",
  "WITH s AS (SELECT user_id, value FROM events WHERE event_type='signup' AND ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)=1) SELECT e.event_id AS id, s.value AS known FROM events e LEFT JOIN s USING (user_id) WHERE e.event_type='error'", At=D(2024, 1, 15))

q("hier_in_hierarchy", "SELECT G.Ref AS ref FROM Catalog.Geography AS G WHERE G.Ref IN HIERARCHY (&Root)",
  "SELECT 'R1' AS ref UNION ALL SELECT 'N'||n_nationkey FROM nation WHERE n_regionkey=1 UNION ALL SELECT 'C'||c_custkey FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=1", Root="R1")
# over the whole hierarchy, customers included; of the null-safe join, one side has a row per parent, so that its result is bounded
_GEO = "WITH g AS (SELECT 'R'||r_regionkey AS ref, NULL::VARCHAR AS parent, r_name AS name FROM region UNION ALL SELECT 'N'||n_nationkey, 'R'||n_regionkey, n_name FROM nation UNION ALL SELECT 'C'||c_custkey, 'N'||c_nationkey, c_name FROM customer)"
q("rel_null_safe_join", "SELECT A.Ref AS ref, B.n AS siblings FROM Catalog.Geography AS A JOIN (SELECT X.Parent AS parent, COUNT(*) AS n FROM Catalog.Geography AS X GROUP BY X.Parent) AS B ON A.Parent = B.parent OR (A.Parent IS NULL AND B.parent IS NULL)",
  _GEO + ", p AS (SELECT parent, count(*) AS n FROM g GROUP BY 1) SELECT ref, n AS siblings FROM g JOIN p ON g.parent IS NOT DISTINCT FROM p.parent")
q("hier_order", "SELECT G.Ref AS ref, G.Description AS name FROM Catalog.Geography AS G ORDER BY ref HIERARCHY", _GEO + " SELECT ref, name FROM g")
q("agg_totals_hierarchy", "SELECT G.Ref AS ref, 1 AS n FROM Catalog.Geography AS G TOTALS SUM(n) BY ref HIERARCHY",
  _GEO + ", c AS (SELECT ref AS anc FROM g UNION ALL SELECT p.ref FROM g JOIN g p ON g.parent = p.ref UNION ALL SELECT pp.ref FROM g JOIN g p ON g.parent = p.ref JOIN g pp ON p.parent = pp.ref) SELECT ref, 1 AS n, NULL::BIGINT AS totals_level FROM g UNION ALL SELECT anc, count(*)::INTEGER, 1 FROM c GROUP BY 1")
_UP = ", c AS (SELECT ref AS anc, ref AS des FROM g UNION ALL SELECT p.ref, g.ref FROM g JOIN g p ON g.parent = p.ref UNION ALL SELECT pp.ref, g.ref FROM g JOIN g p ON g.parent = p.ref JOIN g pp ON p.parent = pp.ref)"
q("agg_totals_overall_hierarchy", "SELECT G.Ref AS ref, 1 AS n FROM Catalog.Geography AS G TOTALS SUM(n) BY OVERALL, ref HIERARCHY",
  _GEO + _UP + " SELECT ref, 1 AS n, NULL::BIGINT AS totals_level FROM g UNION ALL SELECT anc, count(*)::INTEGER, 1 FROM c GROUP BY 1 UNION ALL SELECT NULL, count(*)::INTEGER, 0 FROM g")
q("agg_totals_only_hierarchy", "SELECT G.Ref AS ref, 1 AS n FROM Catalog.Geography AS G TOTALS SUM(n) BY OVERALL, ref ONLY HIERARCHY",
  _GEO + _UP + " SELECT ref, 1 AS n, NULL::BIGINT AS totals_level FROM g UNION ALL SELECT anc, count(*)::INTEGER, 1 FROM c WHERE anc IN (SELECT anc FROM c WHERE anc <> des) GROUP BY 1 UNION ALL SELECT NULL, count(*)::INTEGER, 0 FROM g")
q("agg_totals_group_then_hierarchy", "SELECT N.Region AS region, N.Ref AS nation, P.Ref AS place, 1 AS n FROM Catalog.Nations AS N INNER JOIN Catalog.Geography AS P ON P.Description = N.Description TOTALS SUM(n) BY OVERALL, region, place HIERARCHY",
  _GEO + _UP + ", d AS (SELECT n_regionkey AS region, n_nationkey AS nation, ref AS place FROM nation JOIN g ON g.name = n_name) SELECT region, nation, place, 1 AS n, NULL::BIGINT AS totals_level FROM d UNION ALL SELECT NULL, NULL, NULL, count(*)::INTEGER, 0 FROM d UNION ALL SELECT region, NULL, NULL, count(*)::INTEGER, 1 FROM d GROUP BY region UNION ALL SELECT region, NULL, anc, count(*)::INTEGER, 2 FROM d JOIN c ON c.des = d.place GROUP BY region, anc")
q("agg_totals_periods_by_type", "SELECT E.EventType AS kind, BEGINOFPERIOD(E.Period, MONTH) AS month, COUNT(*) AS n FROM InformationRegister.UserEvents AS E GROUP BY E.EventType, BEGINOFPERIOD(E.Period, MONTH) TOTALS SUM(n) BY kind, month PERIODS(MONTH, &From, &To)",
  "WITH d AS (SELECT event_type AS kind, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT kind, unnest(generate_series(TIMESTAMP '2023-11-01', TIMESTAMP '2024-03-01', INTERVAL 1 MONTH)) AS month FROM (SELECT DISTINCT kind FROM d)) SELECT kind, month, n, NULL::BIGINT AS totals_level FROM d UNION ALL SELECT kind, NULL, sum(n)::BIGINT, 1 FROM d GROUP BY kind UNION ALL SELECT p.kind, p.month, d.n, 2 FROM p LEFT JOIN d USING (kind, month) UNION ALL SELECT d.kind, d.month, d.n, 2 FROM d LEFT JOIN p USING (kind, month) WHERE p.month IS NULL",
  From=D(2023, 11, 1), To=D(2024, 3, 1))
q("rel_record_number_desc", "SELECT O.Ref AS key, O.Total AS total, RECORDAUTONUMBER() AS num FROM Document.Orders AS O ORDER BY O.Total DESC, O.Ref",
  "SELECT o_orderkey AS key, o_totalprice AS total, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS num FROM orders")
q("rel_not_in_nulls", "SELECT G.Ref AS ref FROM Catalog.Geography AS G WHERE NOT G.Parent IN (SELECT X.Parent FROM Catalog.Geography AS X WHERE X.Parent = \"R1\" OR X.Parent = \"R2\")", _GEO + " SELECT ref FROM g WHERE parent NOT IN (SELECT parent FROM g WHERE parent IN ('R1', 'R2'))")
q("rel_not_in_subquery_null", "SELECT G.Ref AS ref FROM Catalog.Geography AS G WHERE NOT G.Ref IN (SELECT X.Parent FROM Catalog.Geography AS X)", _GEO + " SELECT ref FROM g WHERE ref NOT IN (SELECT parent FROM g)")
q("rel_not_in_tuple", "SELECT L.Order AS ord, L.LineNumber AS line FROM Document.Orders.Lines AS L WHERE NOT (L.Order, L.Part) IN (SELECT X.Order, MAX(X.Part) FROM Document.Orders.Lines AS X GROUP BY X.Order)",
  "SELECT l_orderkey AS ord, l_linenumber AS line FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, max(l_partkey) FROM lineitem GROUP BY 1)")
q("rel_autoorder", "SELECT N.Region AS region, N.Description AS name FROM Catalog.Nations AS N AUTOORDER", "SELECT n_regionkey AS region, n_name AS name FROM nation")
q("rel_null_column", "SELECT R.Ref AS key, NULL AS nothing, UNDEFINED AS unknown FROM Catalog.Regions AS R WHERE R.Ref IS NOT NULL", "SELECT r_regionkey AS key, NULL AS nothing, NULL AS unknown FROM region")
q("rel_nested_table", "SELECT O.Ref AS key, O.Lines.(LineNumber AS line, Part AS part) AS lines FROM Document.Orders AS O WHERE O.Status = \"F\"",
  "SELECT o_orderkey AS key, (SELECT list_sort(list(l_linenumber || ':' || l_partkey)) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines FROM orders WHERE o_orderstatus = 'F'",
  shown=lambda df: df.select("key", F.sort_array(F.transform("lines", lambda x: F.concat_ws(":", x["line"], x["part"]))).alias("lines")))
q("rel_external_table", "SELECT P.Ref AS key, P.p_brand AS brand FROM ExternalDataSource.Warehouse.Table.Parts AS P WHERE P.p_size > 40", "SELECT p_partkey AS key, p_brand AS brand FROM part WHERE p_size > 40")
q("rel_filter_criterion", "SELECT F.Table AS tab, F.Ref AS ref FROM FilterCriterion.OfNation(&Nation) AS F", "SELECT 'Catalog.Customers' AS tab, c_custkey::VARCHAR AS ref FROM customer WHERE c_nationkey = 7 UNION SELECT 'Catalog.Suppliers', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey = 7", Nation=7)
q("rel_for_update", "SELECT R.Ref AS key FROM Catalog.Regions AS R FOR UPDATE Catalog.Regions", "SELECT r_regionkey AS key FROM region")
q("rel_value_type", "SELECT VALUETYPE(N.Region) AS kind, COUNT(*) AS n FROM Catalog.Nations AS N WHERE VALUETYPE(N.Region) = TYPE(Catalog.Regions) GROUP BY VALUETYPE(N.Region)", "SELECT 'CATALOG.REGIONS' AS kind, count(*) AS n FROM nation")
q("rel_value_empty_ref", "SELECT N.Ref AS key FROM Catalog.Nations AS N WHERE ISNULL(N.Region, VALUE(Catalog.Regions.EmptyRef)) = VALUE(Catalog.Regions.EUROPE)", "SELECT n_nationkey AS key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
q("fn_string_cast_uuid", "SELECT P.Ref AS key, STRING(P.Size) AS size, UUID(P.Ref) AS id, STOREDDATASIZE(P.Description) AS bytes FROM Catalog.Parts AS P", "SELECT p_partkey AS key, p_size::VARCHAR AS size, p_partkey::VARCHAR AS id, strlen(p_name) AS bytes FROM part")
q("vt_balance_conditioned", "SELECT T.Part AS part, T.Supplier AS supp, ROUND(T.QuantityBalance, 2) AS qty FROM AccumulationRegister.Stock.Balance(&At, ReturnFlag = \"A\") AS T",
  "WITH b AS (SELECT l_partkey AS part, l_suppkey AS supp, sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE -l_quantity END) AS q, sum(CASE WHEN l_linestatus='F' THEN l_extendedprice ELSE -l_extendedprice END) AS a FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1,2) SELECT part, supp, round(q,2) AS qty FROM b WHERE q <> 0 OR a <> 0", At=D(1997, 1, 1))
q("vt_records_with_ext_dimensions", "SELECT R.Order AS ord, R.LineNumber AS line, R.ExtDimensionDr AS dr, R.ExtDimensionCr AS cr FROM AccountingRegister.Journal.RecordsWithExtDimensions() AS R", "SELECT l_orderkey AS ord, l_linenumber AS line, l_suppkey::VARCHAR AS dr, l_partkey::VARCHAR AS cr FROM lineitem")
q("vt_actual_action_period", "SELECT C.employee AS employee, C.ActionPeriodBegin AS since, C.ActionPeriodEnd AS until, C.number AS number FROM CalculationRegister.Charges.ActualActionPeriod() AS C",
  """WITH r AS (SELECT o_custkey AS e, o_orderdate AS b, o_orderdate + INTERVAL 30 DAY * substr(o_orderpriority,1,1)::INTEGER AS t, o_orderkey AS p FROM orders),
 x AS (SELECT DISTINCT e, unnest([b, t]) AS x FROM r), s AS (SELECT e, x, lead(x) OVER (PARTITION BY e ORDER BY x) AS y FROM x QUALIFY y IS NOT NULL),
 w AS (SELECT s.e, s.x, s.y, max(p) AS p FROM s JOIN r ON r.e = s.e AND r.b <= s.x AND s.y <= r.t GROUP BY ALL),
 n AS (SELECT *, CASE WHEN lag(y) OVER (PARTITION BY e, p ORDER BY x) = x THEN 0 ELSE 1 END AS new FROM w), k AS (SELECT *, sum(new) OVER (PARTITION BY e, p ORDER BY x) AS run FROM n)
 SELECT e AS employee, min(x) AS since, max(y) AS until, p AS number FROM k GROUP BY e, p, run""")
q("vt_schedule_data", "SELECT C.charge AS charge, C.ScheduleValue AS hours FROM CalculationRegister.Charges.ScheduleData() AS C",
  "WITH d AS (SELECT o_custkey AS e, date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) * 8.0::DOUBLE AS h FROM orders GROUP BY 1, 2), r AS (SELECT o_orderkey AS charge, o_custkey AS e, o_orderdate AS b, o_orderdate + INTERVAL 30 DAY * substr(o_orderpriority,1,1)::INTEGER AS t FROM orders) SELECT charge, coalesce(sum(h), 0) AS hours FROM r LEFT JOIN d ON d.e = r.e AND d.day >= r.b AND d.day <= r.t GROUP BY charge")
q("vt_task_by_performer", "SELECT T.Ref AS task, T.Performer AS who FROM Task.Errands.TaskByPerformer() AS T",
  "WITH a AS (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END AS office, 'user'||n_regionkey AS person FROM nation) SELECT DISTINCT s_suppkey AS task, person AS who FROM supplier JOIN a ON a.office IS NULL OR a.office = s_nationkey")
q("rel_composite_dereference", "SELECT C.Contact AS contact, C.Owner.Description AS name, C.Owner.Nation.Description AS nation, VALUETYPE(C.Owner) AS kind FROM InformationRegister.Contacts AS C",
  "SELECT c_name AS contact, c_name AS name, n_name AS nation, 'CATALOG.CUSTOMERS' AS kind FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT s_name, s_name, n_name, 'CATALOG.SUPPLIERS' FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
q("rel_composite_cast", "SELECT C.Contact AS contact, CAST(C.Owner AS Catalog.Customers).Segment AS segment FROM InformationRegister.Contacts AS C", "SELECT c_name AS contact, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
q("rel_composite_refs", "ВЫБРАТЬ К.Контакт КАК contact ИЗ РегистрСведений.Контакты КАК К ГДЕ К.Владелец ССЫЛКА Справочник.Поставщики", "SELECT s_name AS contact FROM supplier")
q("rel_allowed_by_text", "SELECT ALLOWED C.Contact AS contact FROM InformationRegister.Contacts AS C", "SELECT c_name AS contact FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal > 5000", Порог=5000)
q("flagship_sales_by_period",
  "ВЫБРАТЬ\n\tНАЧАЛОПЕРИОДА(П.Период, МЕСЯЦ) КАК month,\n\tП.Товар.Марка КАК brand,\n\tОКР(СУММА(П.Количество), 2) КАК qty,\n\tОКР(СУММА(П.Сумма), 2) КАК amount\nИЗ РегистрНакопления.Продажи КАК П\nГДЕ П.Период МЕЖДУ &Начало И &Конец\nСГРУППИРОВАТЬ ПО НАЧАЛОПЕРИОДА(П.Период, МЕСЯЦ), П.Товар.Марка\nУПОРЯДОЧИТЬ ПО amount УБЫВ, month, brand // выручка",
  "SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, p_brand AS brand, round(sum(l_quantity),2) AS qty, round(sum(l_extendedprice),2) AS amount FROM lineitem LEFT JOIN part ON l_partkey=p_partkey WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1,2", Начало=D(1995, 1, 1), Конец=D(1996, 12, 31))
