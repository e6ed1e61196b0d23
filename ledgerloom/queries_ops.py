"""Queries of the operators beside the query language: windows, search, graph, diff, rules, metrics, reports, streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import code, diff, graph, hierarchy, metrics, reports, rules, search
from ledgerloom.sources.metadata import strip_html
from ledgerloom.sources.sinks import sarif_results
from ledgerloom.session import shared_folder, spread, table
from ledgerloom.streaming import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- windows
@query("SELECT o_orderkey AS key, o_custkey AS cust, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_total(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT p_brand AS brand, p_partkey AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 3")
def win_rank_topk_per_group(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("key"), F.row_number().over(w).alias("rank")).where("rank <= 3")


@query("SELECT event_id AS id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def win_previous_value(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.lag("value").over(w).alias("before"))


# -- search
ASKED = ["права", "пользователей", "проверяет"]
_IN = ", ".join(f"'{t}'" for t in ASKED)
_TOK = "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS w FROM documents WHERE text IS NOT NULL)"
_BM25 = _TOK + f""", l AS (SELECT doc_id, len(w) AS len FROM t), n AS (SELECT count(*) AS n, avg(len) AS a FROM l), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN ({_IN}) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), s AS (SELECT doc_id, sum(ln(1+(n-df+0.5)/(df+0.5)) * tf*2.5/(tf+1.5*(0.25+0.75*len/greatest(a,1)))) AS score FROM p JOIN df USING(term) JOIN l USING(doc_id), n GROUP BY 1)"""


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL"))


@query(_BM25 + " SELECT doc_id, round(score, 6) AS score FROM s")
def search_bm25_scores(spark, d):
    return search.bm25(_docs(spark, d), "doc_id", tx.words_column(F.col("text")), ASKED).select("doc_id", F.round("score", 6).alias("score"))


@query(_BM25 + " SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
def search_bm25_topk(spark, d):
    scored = search.bm25(_docs(spark, d), "doc_id", tx.words_column(F.col("text")), ASKED).withColumn("score", F.round("score", 9))
    return search.top(scored, "score", "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


_TFIDF = _TOK + f""", p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL), n AS (SELECT count(*) AS n FROM t), i AS (SELECT term, ln(n/count(*)::DOUBLE) AS idf FROM p, n GROUP BY term, n),
 v AS (SELECT doc_id, term, tf*idf AS w FROM p JOIN i USING(term)), m AS (SELECT doc_id, sqrt(sum(w*w)) AS norm FROM v GROUP BY 1), q AS (SELECT term, idf AS qw FROM i WHERE term IN ({_IN})), qn AS (SELECT sqrt(sum(qw*qw)) AS qnorm FROM q),
 s AS (SELECT doc_id, sum(w*qw)/(any_value(norm)*any_value(qnorm)) AS score FROM v JOIN q USING(term) JOIN m USING(doc_id), qn GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0"""


@query(_TFIDF)
def search_tfidf(spark, d):
    return search.tfidf(_docs(spark, d), "doc_id", tx.words_column(F.col("text")), ASKED).select("doc_id", F.round("score", 6).alias("score"))


@query()
def search_bm25_stemmed(spark, d):
    m = table(spark, d, "methods").select("id", F.concat_ws(" ", "name_ru", "name_ru", "name_ru", "name_en", "name_en", "description").alias("body"))
    stemmed = m.select("id", tx.stems_column(F.col("body")).alias("w"))
    return search.top(search.bm25(stemmed, "id", F.col("w"), tx.stems("ПроверитьОстаткиПоСкладу")), "score", "id", 20)


@query("""WITH g AS (SELECT id, {g} AS g FROM methods WHERE name_ru IS NOT NULL), q AS (SELECT {q} AS q), s AS (SELECT id, len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q)))::DOUBLE AS score FROM g, q WHERE list_has_any(g, q))
 SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20""".format(**{k: f"list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[а-яёa-z]{{3,}}'), lambda w: list_transform(generate_series(1, length(w) + 2), lambda i: substr('$$' || w || '$$', i, 3)))))" for k, c in (("g", "name_ru"), ("q", "'ПолучитОстатокНаДату'"))}))
def search_trigram_fuzzy(spark, d):
    m = table(spark, d, "methods").select("id", "name_ru").where("name_ru IS NOT NULL")
    return search.top(search.trigram_jaccard(m, "id", F.col("name_ru"), "ПолучитОстатокНаДату"), "score", "id", 20)


@query()
def search_blend(spark, d):
    m = table(spark, d, "methods").select("id", "name_ru", "description").where("name_ru IS NOT NULL")
    text = search.bm25(m, "id", tx.words_column(F.concat_ws(" ", "name_ru", "description")), ["остатки", "складам"])
    return search.top(search.blend(text, search.trigram_jaccard(m, "id", F.col("name_ru"), "остатки складам"), "id"), "score", "id", 20)


@query("""WITH m AS (SELECT id, name_ru, lower(coalesce(name_ru, '')) AS r, lower(coalesce(name_en, '')) AS e, lower(concat_ws(' ', name_ru, name_en, description)) AS body FROM methods), s AS (SELECT id, name_ru, CASE WHEN r = 'получитьостатокнадату' OR e = 'получитьостатокнадату' THEN 10.0 WHEN contains(' ' || body, ' получитьостатокнадату') THEN 2.0 WHEN contains(body, 'получитьостатокнадату') THEN 1.0 END::DOUBLE AS score FROM m)
 SELECT id, name_ru, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name_ru ORDER BY score DESC, id) = 1 ORDER BY score DESC, id LIMIT 20""")
def search_catalogue(spark, d):
    m = table(spark, d, "methods").select("id", "name_ru", "name_en", "description")
    return search.catalogue_search(m, "ПолучитьОстатокНаДату", 20)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id % 50 = 0)
 SELECT query, key, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def search_vector_cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding").where("embedding IS NOT NULL")
    # as queries every row whose id is divisible by 50, against all rows
    return search.cosine_top(v, "vec_id", "embedding", v.where("vec_id % 50 = 0"), 10).select("query", "key", F.round("score", 6).alias("score"), "rank")


def _two_lists(spark, d):
    docs = _docs(spark, d)
    words = tx.words_column(F.col("text"))
    a = search.bm25(docs, "doc_id", words, ["права", "пользователей"]).withColumn("score", F.round("score", 6))
    b = search.bm25(docs, "doc_id", words, ["курсы", "валют"]).withColumn("score", F.round("score", 6))
    return search.top(a, "score", "doc_id", 50), search.top(b, "score", "doc_id", 50)


def _list_sql(name, terms):
    inside = ", ".join(f"'{t}'" for t in terms)
    return _BM25.replace(_IN, inside).replace("WITH t AS", f"{name} AS (WITH t AS") + f" SELECT doc_id, round(score, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 50)"


_LISTS = "WITH " + _list_sql("a", ["права", "пользователей"]) + ", " + _list_sql("b", ["курсы", "валют"])
_MM = ", an AS (SELECT doc_id, CASE WHEN hi=lo THEN score ELSE (score-lo)/(hi-lo) END AS score FROM a, (SELECT min(score) lo, max(score) hi FROM a)), bn AS (SELECT doc_id, CASE WHEN hi=lo THEN score ELSE (score-lo)/(hi-lo) END AS score FROM b, (SELECT min(score) lo, max(score) hi FROM b))"


@query(_LISTS + _MM + " SELECT doc_id, round(0.6*coalesce(an.score,0)+0.4*coalesce(bn.score,0), 6) AS score FROM an FULL JOIN bn USING(doc_id)")
def search_weighted_fusion(spark, d):
    return search.weighted_fusion(*_two_lists(spark, d), "doc_id", 0.6).select("doc_id", F.round("score", 6).alias("score"))


@query(_LISTS + ", r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rk FROM a UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM b) SELECT doc_id, round(sum(1.0::DOUBLE/(60+rk)), 8) AS score FROM r GROUP BY 1")
def search_rrf(spark, d):
    return search.rrf(_two_lists(spark, d), "doc_id").select("doc_id", F.round("score", 8).alias("score"))


@query(_LISTS + _MM + " SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM an UNION ALL SELECT * FROM bn) GROUP BY 1")
def search_combsum(spark, d):
    return search.comb(_two_lists(spark, d), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(_LISTS + _MM + " SELECT doc_id, round(sum(score)*count(*), 6) AS score FROM (SELECT * FROM an UNION ALL SELECT * FROM bn) GROUP BY 1")
def search_combmnz(spark, d):
    return search.comb(_two_lists(spark, d), "doc_id", mnz=True).select("doc_id", F.round("score", 6).alias("score"))


@query()
def search_mmr(spark, d):
    fused = search.rrf(_two_lists(spark, d), "doc_id")
    return search.mmr(fused.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", 10)


# -- graph
_FK = "WITH e AS (SELECT 'nation'||n_nationkey AS src, 'region'||n_regionkey AS dst, 'region' AS relation FROM nation UNION ALL SELECT 'customer'||c_custkey, 'nation'||c_nationkey, 'nation' FROM customer UNION ALL SELECT 'supplier'||s_suppkey, 'nation'||s_nationkey, 'nation' FROM supplier)"


def _fk(spark, d):
    n, c, s = (table(spark, d, t) for t in ("nation", "customer", "supplier"))
    edge = lambda df, a, ka, b, kb, r: df.select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"), F.lit(r).alias("relation"))
    return edge(n, "nation", "n_nationkey", "region", "n_regionkey", "region").unionByName(edge(c, "customer", "c_custkey", "nation", "c_nationkey", "nation")).unionByName(edge(s, "supplier", "s_suppkey", "nation", "s_nationkey", "nation"))


@query(_FK + " SELECT src, dst, relation FROM e")
def graph_fk_edges(spark, d):
    return _fk(spark, d)


@query(_FK + " SELECT src, relation FROM e WHERE dst = 'nation3'")
def graph_predecessors(spark, d):
    return graph.predecessors(_fk(spark, d), "nation3")


@query(_FK + " SELECT dst, relation FROM e WHERE src = 'customer7'")
def graph_successors(spark, d):
    return graph.successors(_fk(spark, d), "customer7")


@query(_FK.replace("WITH e", "WITH RECURSIVE e") + ", r(node, depth) AS (SELECT src, 1 FROM e WHERE dst='region2' UNION ALL SELECT e.src, depth+1 FROM e JOIN r ON e.dst = r.node WHERE depth < 9) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1")
def graph_transitive_dependents(spark, d):
    return graph.transitive(_fk(spark, d), "region2", backwards=True)


@query("SELECT unnest(['customer5', 'nation'||n, 'region'||r]) AS node, unnest([0,1,2]) AS step FROM (SELECT c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE c_custkey=5)")
def graph_shortest_path(spark, d):
    e = _fk(spark, d)
    region = table(spark, d, "customer").where("c_custkey = 5").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first().n_regionkey
    path = graph.shortest_path(e, "customer5", f"region{region}")
    return spark.createDataFrame([(n, i) for i, n in enumerate(path)], "node string, step int")


@query(_FK + ", n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), i AS (SELECT dst AS node, count(DISTINCT src) AS c FROM e GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS c FROM e GROUP BY 1) SELECT count(*) AS nodes, (SELECT count(DISTINCT (src,dst)) FROM e) AS edges, round((SELECT count(DISTINCT (src,dst)) FROM e)/(count(*)*(count(*)-1.0::DOUBLE)), 8) AS density, count(*) FILTER (i.c IS NULL) AS unused, count(*) FILTER (o.c IS NULL AND i.c > 0) AS roots FROM n LEFT JOIN i USING(node) LEFT JOIN o USING(node)")
def graph_stats(spark, d):
    e = _fk(spark, d)
    return graph.stats(e, e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())


@query("WITH e AS (SELECT DISTINCT n_regionkey AS a, (n_nationkey % 5) AS b FROM nation WHERE n_regionkey <> n_nationkey % 5) SELECT DISTINCT [least(x.a,x.b), greatest(x.a,x.b)] AS path FROM e x JOIN e y ON x.a=y.b AND x.b=y.a")
def graph_two_cycles(spark, d):
    e = table(spark, d, "nation").select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") % 5).alias("dst"))
    return graph.cycles(e, 2)


@query()
def graph_call_edges(spark, d):
    return graph.call_edges(table(spark, d, "bsl_modules"), "module_id", "bsl_code").groupBy("module", "method").agg(F.count(F.lit(1)).alias("calls"))


@query("SELECT 'N'||n_nationkey AS descendant, 'R'||n_regionkey AS ancestor, 1 AS depth FROM nation UNION ALL SELECT 'N'||n_nationkey, 'N'||n_nationkey, 0 FROM nation")
def hier_closure_depth(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("k"), F.concat(F.lit("R"), "n_regionkey").alias("p"))
    return hierarchy.closure(n, "k", "p")


# -- diff
@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' GROUP BY 1), w AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderpriority) AS p FROM orders WHERE o_orderdate < TIMESTAMP '1996-09-01' AND o_orderdate > TIMESTAMP '1993-01-01' GROUP BY 1)
 SELECT k, CASE WHEN o.n IS NULL THEN 'added' WHEN w.n IS NULL THEN 'removed' ELSE 'modified' END AS change, CASE WHEN o.n IS NULL OR w.n IS NULL THEN []::VARCHAR[] ELSE list_filter([CASE WHEN o.n IS DISTINCT FROM w.n THEN 'n' END, CASE WHEN o.p IS DISTINCT FROM w.p THEN 'p' END], lambda x: x IS NOT NULL) END AS fields FROM o FULL JOIN w USING(k) WHERE o.n IS DISTINCT FROM w.n OR o.p IS DISTINCT FROM w.p""")
def diff_added_removed_modified(spark, d):
    o = table(spark, d, "orders")
    state = lambda x: x.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("p"))
    return diff.keyed_diff(state(o.where("o_orderdate < '1996-06-01'")), state(o.where("o_orderdate < '1996-09-01' AND o_orderdate > '1993-01-01'")), ["k"], ["n", "p"])


@query("""WITH s AS (SELECT o_custkey AS k, list_distinct(list(o_orderpriority)) AS c, o_orderdate < TIMESTAMP '1995-06-01' AS old FROM orders GROUP BY 1, 3) SELECT a.k, list_sort(list_filter(b.c, lambda x: NOT list_contains(a.c, x))) AS added, list_sort(list_filter(a.c, lambda x: NOT list_contains(b.c, x))) AS removed FROM s a JOIN s b ON a.k=b.k AND a.old AND NOT b.old WHERE len(added) > 0 OR len(removed) > 0""")
def diff_child_sets(spark, d):
    o = table(spark, d, "orders")
    sets = lambda x: x.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("c"))
    return diff.child_sets(sets(o.where("o_orderdate < '1995-06-01'")), sets(o.where("o_orderdate >= '1995-06-01'")), "k", "c")


@query("SELECT DISTINCT rule_id, method_name, 'new' AS state FROM context_violations WHERE detected_at >= TIMESTAMP '2024-06-01' AND (rule_id, method_name) NOT IN (SELECT rule_id, method_name FROM context_violations WHERE detected_at < TIMESTAMP '2024-06-01' AND rule_id IS NOT NULL AND method_name IS NOT NULL) AND rule_id IS NOT NULL AND method_name IS NOT NULL UNION ALL SELECT DISTINCT rule_id, method_name, 'fixed' FROM context_violations WHERE detected_at < TIMESTAMP '2024-06-01' AND (rule_id, method_name) NOT IN (SELECT rule_id, method_name FROM context_violations WHERE detected_at >= TIMESTAMP '2024-06-01' AND rule_id IS NOT NULL AND method_name IS NOT NULL) AND rule_id IS NOT NULL AND method_name IS NOT NULL")
def diff_baseline(spark, d):
    v = table(spark, d, "context_violations").where("rule_id IS NOT NULL AND method_name IS NOT NULL")
    return diff.baseline(v.where("detected_at < '2024-06-01'"), v.where("detected_at >= '2024-06-01'"), ["rule_id", "method_name"])


# -- rules and metrics
@query("WITH l AS (SELECT module_id, unnest(regexp_split_to_array(bsl_code, '\\r\\n|\\n|\\r')) AS t FROM bsl_modules WHERE bsl_code IS NOT NULL) SELECT r AS rule_id, count(*) AS n FROM (SELECT CASE WHEN length(t) > 120 THEN 'STD456-LENGTH' END AS r FROM l UNION ALL SELECT CASE WHEN regexp_matches(t, '[–—]') THEN 'STD456-DASH' END FROM l UNION ALL SELECT CASE WHEN regexp_matches(t, 'ЗаписьЖурналаРегистрации\\s*\\(') THEN 'STD-JOURNAL' END FROM l UNION ALL SELECT CASE WHEN regexp_matches(t, 'Сообщить\\s*\\(') THEN 'ARC-MESSAGE' END FROM l UNION ALL SELECT CASE WHEN regexp_matches(t, '([Пп]ароль|[Pp]assword)\\s*=\\s*\"[^\"]+\"') THEN 'SEC004' END FROM l) WHERE r IS NOT NULL GROUP BY 1")
def rule_lines_core(spark, d):
    chosen = [r for r in rules.LINE_RULES if r.id in ("STD456-LENGTH", "STD456-DASH", "STD-JOURNAL", "ARC-MESSAGE", "SEC004")]
    lines = rules.source_lines(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "module_id", "bsl_code")
    return rules.check_lines(lines, chosen).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(rules.lines_sql("SELECT module_id, unnest(t) AS text, generate_subscripts(t, 1)::INTEGER AS line FROM (SELECT module_id, regexp_split_to_array(bsl_code, '\\r\\n|\\n|\\r') AS t FROM bsl_modules WHERE bsl_code IS NOT NULL)"))
def rule_lines_all(spark, d):
    return rules.check_lines(rules.source_lines(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "module_id", "bsl_code"))


@query()
def rule_context(spark, d):
    return rules.check_context(table(spark, d, "bsl_modules"), "module_id", "bsl_code")


@query()
def rule_stateful(spark, d):
    return rules.check_stateful(table(spark, d, "bsl_modules").select("module_id", "bsl_code"), "module_id", "bsl_code")


_QUERY_SOURCES = r"""SELECT 'documents' AS src, doc_id AS rec_id, i::INTEGER AS pos, regexp_extract(b, '(?is)(?:^|\n)[ \t]*((?:выбрать|select)[ \t\n].*)$', 1) AS query FROM (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n[ \t]*\n|```') AS bs FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(lower(regexp_extract(b, '(?is)(?:^|\n)[ \t]*((?:выбрать|select)[ \t\n].*)$', 1)), '[\s](из|from)\s')
 UNION ALL SELECT 'bsl_modules', module_id, i::INTEGER, regexp_replace(replace(m, '""', '"'), '(\r\n|\n|\r)[ \t]*[|]?', chr(10), 'g') FROM (SELECT module_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM (SELECT module_id, regexp_extract_all(bsl_code, '(?i)(?:запрос\.?текст|\.?текст|\.?text|query\.text|текстзапроса|querytext)\s*=\s*"((?:[^"]|"")*)"', 1) AS ms FROM bsl_modules WHERE bsl_code IS NOT NULL)) WHERE trim(m) <> ''"""


def _query_texts(spark, d):
    docs = code.query_blocks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text").select(F.lit("documents").alias("src"), F.col("doc_id").alias("rec_id"), "pos", "query")
    modules = code.query_texts(spread(table(spark, d, "bsl_modules").select("module_id", "bsl_code")), "module_id", "bsl_code")
    return docs.unionByName(modules.select(F.lit("bsl_modules").alias("src"), F.col("module_id").alias("rec_id"), "pos", "query"))


@query(_QUERY_SOURCES)
def code_query_texts(spark, d):
    """Every query text in documents and in string literals of source modules."""
    return _query_texts(spark, d)


@query(rules.queries_sql(_QUERY_SOURCES))
def rule_query_texts(spark, d):
    """All query rules over all of them."""
    return rules.check_queries(_query_texts(spark, d), "rec_id", "query").select("src", "rec_id", "pos", "rule_id")


@query()
def rule_sarif(spark, d):
    return sarif_results(rules.check_context(table(spark, d, "bsl_modules"), "module_id", "bsl_code"), "module_id", "line")


@query("SELECT rule_id, upper(severity) AS severity, count(*) AS n FROM context_violations GROUP BY 1, 2")
def rule_violation_stats(spark, d):
    return table(spark, d, "context_violations").groupBy("rule_id", F.upper("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT module_path, CASE lower(severity) WHEN 'error' THEN 2 WHEN 'warning' THEN 3 ELSE 4 END AS r, rule_id, count(*) AS n FROM context_violations GROUP BY ALL)
 SELECT module_path, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE r <= 2), 0)::BIGINT AS must_fix, CASE WHEN min(r) <= 2 THEN 'errors' ELSE 'warnings' END AS verdict, list_slice(list(rule_id ORDER BY r, rule_id NULLS FIRST), 1, 3) AS top3 FROM p GROUP BY 1""")
def rule_verdict_top3(spark, d):
    v = table(spark, d, "context_violations").withColumn("sev", F.when(F.lower("severity") == "error", "HIGH").when(F.lower("severity") == "warning", "MEDIUM").otherwise("LOW"))
    return metrics.verdict(v, "module_path", "sev", "rule_id")


@query("""WITH l AS (SELECT module_id, bsl_code, regexp_split_to_array(coalesce(bsl_code,''), '\\r\\n|\\n|\\r') AS ls FROM bsl_modules) SELECT module_id, len(ls) AS total, len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*//'))) AS comment, len(list_filter(ls, lambda x: regexp_replace(x, '\\s', '', 'g') = '')) AS blank FROM l""")
def ops_line_metrics(spark, d):
    return metrics.code_metrics(table(spark, d, "bsl_modules"), "module_id", "bsl_code").select("module_id", "total", "comment", "blank")


@query()
def ops_code_metrics(spark, d):
    return metrics.health(metrics.code_metrics(table(spark, d, "bsl_modules"), "module_id", "bsl_code"))


@query()
def ops_duplicate_blocks(spark, d):
    return metrics.duplicate_blocks(table(spark, d, "bsl_modules"), "module_id", "bsl_code")


_SLI = """WITH c AS (SELECT user_id % 20 AS tool, event_type <> 'error' AS ok, value FROM events), s AS (SELECT tool, count(*) AS total, count(*) FILTER (NOT ok) AS failed, round(avg(value),6) AS avg_latency, list_sort(list(value)) AS v FROM c GROUP BY 1)
 SELECT tool, total, failed, round(failed/total,6) AS error_rate, round(1-failed/total,6) AS success_rate, avg_latency, v[len(v)//2+1] AS p50, v[(floor(len(v)*0.99::DOUBLE))::BIGINT+1] AS p99 FROM s"""


def _calls(spark, d):
    return table(spark, d, "events").withColumn("tool", F.col("user_id") % 20)


@query(_SLI)
def ops_sli_metrics(spark, d):
    return metrics.sli(_calls(spark, d), "tool", F.col("event_type") != "error", "value")


@query("SELECT tool, p99 < 5000 AS latency_ok, error_rate < 0.05 AS errors_ok, success_rate > 0.95 AS success_ok FROM (" + _SLI + ")")
def ops_slo_check(spark, d):
    return metrics.slo_check(metrics.sli(_calls(spark, d), "tool", F.col("event_type") != "error", "value"))


@query()
def ops_rate_limit(spark, d):
    return metrics.rate_limit(table(spark, d, "events").select("event_id", "ts", "event_type"), "event_type", "ts", 5, 600)


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def ops_ttl_fifo(spark, d):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return metrics.ttl_fifo(table(spark, d, "events"), "user_id", "ts", "event_id", now, 864_000, 3).select("event_id", "user_id")


@query("SELECT version FROM platform_versions WHERE list_transform(string_split(version, '.'), lambda x: x::INTEGER) >= [8,3,12]")
def ops_version_compare(spark, d):
    v = table(spark, d, "platform_versions")
    return v.where(tx.version_parts(F.col("version")) >= tx.version_parts(F.lit("8.3.12"))).select("version")


@query("SELECT doc_id, coalesce(b.n, 'unknown') AS intent, round(coalesce(b.c, 0), 4) AS confidence FROM (SELECT doc_id, list_sort(list_filter([" + ", ".join("{{'c': CASE WHEN {k} > 0 THEN least(1.0::DOUBLE, {c}::DOUBLE + 0.05::DOUBLE * ({k} - 1)) END, 'n': '{n}'}}".format(n=n, c=c, k="len(regexp_extract_all(text, '" + p.replace("(?iu)", "(?i)") + "'))") for n, c, p in rules.INTENTS) + "], lambda x: x.c IS NOT NULL), 'DESC')[1] AS b FROM documents WHERE text IS NOT NULL)")
def ops_intent(spark, d):
    return rules.classify_intent(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT event_id AS id, (props->>'k')::BIGINT AS k FROM events")
def ops_json_props(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(r"""SELECT id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(description, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[\s\x{a0}]+', ' ', 'g')) AS text FROM methods""")
def ops_html_strip(spark, d):
    return table(spark, d, "methods").select("id", strip_html(F.col("description")).alias("text"))


@query("SELECT object_type, count(DISTINCT uuid) AS objects, count(*) AS deliveries FROM config_objects GROUP BY 1")
def ops_object_statistics(spark, d):
    return table(spark, d, "config_objects").groupBy("object_type").agg(F.count_distinct("uuid").alias("objects"), F.count(F.lit(1)).alias("deliveries"))


@query("SELECT module_id, sha256(coalesce(bsl_code, '')) AS digest FROM bsl_modules")
def ops_content_hash(spark, d):
    return table(spark, d, "bsl_modules").select("module_id", F.sha2(F.coalesce("bsl_code", F.lit("")), 256).alias("digest"))


# -- reports
@query("SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_extendedprice),2) AS amount, count(l_orderkey) AS n, (CASE WHEN grouping(l_returnflag)=1 THEN 0 WHEN grouping(l_linestatus)=1 THEN 1 ELSE 2 END)::INTEGER AS level FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
def report_group_totals(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_extendedprice").alias("a"), F.col("l_orderkey").alias("k"))
    return reports.grouped(x, ["flag", "status"], {"amount": ("Сумма", "a"), "n": ("Количество", "k")}).withColumn("amount", F.round("amount", 2))


@query("SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority='1-URGENT') AS urgent, count(*) FILTER (o_orderpriority='5-LOW') AS low FROM orders GROUP BY 1")
def report_crosstab_pivot(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderpriority", F.lit(1).alias("one"))
    out = reports.cross_table(x, ["status"], "o_orderpriority", "count", "one", ["1-URGENT", "5-LOW"])
    return out.select("status", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT p_brand AS brand, avg(p_size) AS value, p_type AS kind FROM part WHERE p_brand IN ('Brand#11','Brand#12') AND p_size > 5 GROUP BY ALL")
def report_chart_filtered(spark, d):
    cond = reports.report_filter(("and", ("p_brand", "InList", ["Brand#11", "Brand#12"]), ("p_size", "Greater", 5)))
    return reports.chart(table(spark, d, "part").where(cond), "p_brand", "p_type", "Среднее", "p_size").withColumnsRenamed({"p_brand": "brand", "p_type": "kind"})


# -- streams; windows and sessions in complete mode: at the end of the input those still open come out too
def _stream(spark, d):
    return pipelines.event_stream(spark, d, spark.read.parquet(f"{d}/events.parquet").schema)


def _drain(df, name, mode="append"):
    return pipelines.drain(df, f"{shared_folder(df.sparkSession)}/streams/{name}-{uuid.uuid4().hex}", mode)


_TIMES = "SELECT {w} AS start, {w} + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events{x} GROUP BY ALL"


@query(_TIMES.format(w="date_trunc('hour', ts)::TIMESTAMP", x=""))
def stream_tumbling(spark, d):
    return _drain(pipelines.windowed(_stream(spark, d), "1 hour"), "stream_tumbling", "complete")


@query(_TIMES.format(w="time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k", x=", (SELECT unnest([0, 1]) AS k)"))
def stream_sliding(spark, d):
    return _drain(pipelines.windowed(_stream(spark, d), "1 hour", "30 minutes"), "stream_sliding", "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    return _drain(pipelines.sessions(_stream(spark, d), "30 minutes"), "stream_session", "complete")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_dedupe(spark, d):
    return _drain(pipelines.deduplicated(_stream(spark, d), "event_id"), "stream_dedupe")


@query()
def stream_rate_limit(spark, d):
    return _drain(pipelines.rate_limited(_stream(spark, d), "event_type", 5, 600), "stream_rate_limit")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, user_id % 20 AS tool, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, round(avg(value), 6) AS avg_latency FROM events GROUP BY ALL")
def stream_running_sli(spark, d):
    calls = _stream(spark, d).select("ts", (F.col("user_id") % 20).alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return _drain(pipelines.running_sli(calls, "1 day"), "stream_running_sli", "complete")


@query("SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def stream_new_against_baseline(spark, d):
    folder = f"{shared_folder(spark)}/streams/new-{uuid.uuid4().hex}"
    known = table(spark, d, "events").where("event_type = 'view'")
    pipelines.new_against_baseline(_stream(spark, d).select("event_id", "user_id"), known, "event_id", f"{folder}/rows", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("event_id", "user_id")
