"""Source modules as data: methods, calls, embedded query texts, and the graph of calls between modules.

A file is read once, line by line, in the task that holds it; everything after that (who calls whom, what nobody calls,
which modules depend on each other in a ring) is joins over the resulting tables.  Null and empty sources give no rows; a
method without an end keyword reaches to the next one or to the file's end; names compare without case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES = re.compile(r"\r\n|\n|\r")
HEAD = re.compile(r"^[\s﻿]*(?:(?:асинх|async)\s+)?(процедура|функция|procedure|function)\s+(\w+)\s*\((.*)$", re.I)
TAIL = re.compile(r"^\s*(?:конецпроцедуры|конецфункции|endprocedure|endfunction)\b", re.I)
CALL = re.compile(r"(?<![\w.\"])(?:(\w+)\.)?(\w+)\s*\(")
#: words that stand before a parenthesis without being calls
NO_CALL = frozenset("если иначеесли пока и или не для возврат новый процедура функция if elsif while and or not for return new procedure function знач val из in по to".split())
METHODS = "rec_id bigint, module string, method string, kind string, line int, last_line int, exported boolean, params array<string>, directive string, doc string, region string"
CALLS = "rec_id bigint, caller_module string, caller_method string, callee_module string, callee_method string, line int"


def bare(line: str) -> str:
    """The line with its strings emptied and its comment cut off."""
    out, quoted, i = [], line.lstrip().startswith("|"), 0
    while i < len(line):
        c = line[i]
        if c == '"':
            quoted = not quoted
            out.append(c)
        elif not quoted and c == "/" and line.startswith("//", i):
            break
        elif not quoted:
            out.append(c)
        i += 1
    return "".join(out)


def module_name(path: str | None) -> str:
    """The name by which code calls a module: of a dotted path the second part, else the file's folder or name."""
    parts = [p for p in re.split(r"[./\\]", path or "") if p]
    return parts[1] if len(parts) > 1 else parts[0] if parts else ""


def read_methods(text: str) -> list[dict]:
    """Methods of a file in order."""
    lines = LINES.split(text)
    out: list[dict] = []
    regions: list[str] = []
    for i, line in enumerate(lines):
        if (m := re.match(r"^\s*#\s*(?:область|region)\s+(\w+)", line, re.I)) is not None:
            regions.append(m[1])
        elif re.match(r"^\s*#\s*(?:конецобласти|endregion)\b", line, re.I) and regions:
            regions.pop()
        if TAIL.match(line) and out and out[-1]["last_line"] is None:
            out[-1]["last_line"] = i + 1
        m = HEAD.match(line)
        if not m:
            continue
        if out and out[-1]["last_line"] is None:
            out[-1]["last_line"] = i
        head, depth, j = "", 1, i
        rest = bare(m[3])
        while True:  # the signature, to its closing parenthesis
            for at, c in enumerate(rest):
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    head, rest = head + rest[:at], rest[at + 1 :]
                    break
            else:
                head += rest + " "
                j += 1
                if j >= len(lines):
                    break
                rest = bare(lines[j])
                continue
            break
        params = [w[-1] for p in head.split(",") if (w := re.findall(r"\w+", p.split("=")[0]))]
        above = i - 1
        directive = None
        while above >= 0 and re.match(r"^[\s﻿]*&", lines[above]):
            directive, above = directive or lines[above].strip().lstrip("&"), above - 1
        doc = []
        while above >= 0 and re.match(r"^[\s﻿]*//", lines[above]):
            doc.insert(0, re.sub(r"^[\s﻿]*//+\s?", "", lines[above]))
            above -= 1
        kind = "function" if m[1].lower() in ("функция", "function") else "procedure"
        out.append({"method": m[2], "kind": kind, "line": i + 1, "last_line": None, "exported": bool(re.match(r"\s*(?:экспорт|export)\b", rest, re.I)), "params": params, "directive": directive, "doc": "\n".join(doc) or None, "region": regions[-1] if regions else None})
    if out and out[-1]["last_line"] is None:
        out[-1]["last_line"] = len(lines)
    return out


def read_calls(text: str) -> Iterator[tuple[str | None, str | None, str, int]]:
    """(enclosing method, called module or None, called method, line): the method of a line is the nearest header above it."""
    within: str | None = None
    for n, line in enumerate(LINES.split(text), 1):
        m = HEAD.match(line)
        if m:
            within = m[2]
            continue
        if "(" in line:
            for c in CALL.finditer(bare(line)):
                if c[1] is not None or c[2].lower() not in NO_CALL:
                    yield within, c[1], c[2], n
        if TAIL.match(line):
            within = None


def _scan(code: DataFrame, key: str, path: str, text: str, read, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for k, p, t in zip(b["k"], b["p"], b["t"]) if isinstance(t, str) for r in read(k, module_name(p), t)], columns=names)

    return code.select(F.col(key).cast("bigint").alias("k"), F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(run, schema)


def methods_of(code: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Every procedure and function: its module, lines, parameters, directive, comment block and region."""
    names = [c.split()[0] for c in METHODS.split(", ")][2:]
    return _scan(code, key, path, text, lambda k, m, t: [(k, m, *(f[c] for c in names)) for f in read_methods(t)], METHODS)


def exported_api(methods: DataFrame) -> DataFrame:
    """module, method, signature, doc of exported methods: a configuration's own interface."""
    head = F.concat("method", F.lit("("), F.array_join("params", ", "), F.lit(")"))
    return methods.where("exported").select("module", "method", "kind", head.alias("signature"), "doc")


def call_graph(code: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Calls inside methods: unqualified ones go to the same module."""
    return _scan(code, key, path, text, lambda k, m, t: [(k, m, a, q if q is not None else m, c, n) for a, q, c, n in read_calls(t) if a is not None], CALLS)


def _node(module: str, method: str) -> Column:
    return F.lower(F.concat_ws(".", module, method))


def known_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """The calls whose callee is a method of some module."""
    there = methods.select(_node("module", "method").alias("__callee")).distinct()
    return calls.withColumn("__callee", _node("callee_module", "callee_method")).join(there, "__callee", "left_semi").drop("__callee")


def callers(calls: DataFrame, module: str, method: str) -> DataFrame:
    return calls.where(_node("callee_module", "callee_method") == f"{module}.{method}".lower()).select("caller_module", "caller_method", "line")


def callees(calls: DataFrame, module: str, method: str) -> DataFrame:
    return calls.where(_node("caller_module", "caller_method") == f"{module}.{method}".lower()).select("callee_module", "callee_method", "line")


def dead_exports(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """module, method of exported methods that nobody calls: an anti join on the names called."""
    called = calls.select(_node("callee_module", "callee_method").alias("__n")).distinct()
    return methods.where("exported").withColumn("__n", _node("module", "method")).join(called, "__n", "left_anti").select("module", "method").distinct()


def call_edges(calls: DataFrame) -> DataFrame:
    """src, dst, relation of calls between different methods, for the graph operators."""
    return calls.select(_node("caller_module", "caller_method").alias("src"), _node("callee_module", "callee_method").alias("dst"), F.lit("calls").alias("relation")).where("src <> dst").distinct()


def call_statistics(calls: DataFrame) -> DataFrame:
    """edges, nodes, callers, callees in numbers."""
    a, b = _node("caller_module", "caller_method"), _node("callee_module", "callee_method")
    ends = calls.select(F.explode(F.array(a, b)).alias("n")).agg(F.count_distinct("n").alias("nodes"))
    return calls.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct(a).alias("callers"), F.count_distinct(b).alias("callees")).join(F.broadcast(ends))  # one row each


def module_edges(calls: DataFrame) -> DataFrame:
    """src, dst, n: dependencies between modules."""
    return calls.where(F.lower("caller_module") != F.lower("callee_module")).groupBy(F.lower("caller_module").alias("src"), F.lower("callee_module").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def module_findings(code: DataFrame, key: str, path: str, text: str, most_lines: int = 1000, most_methods: int = 50, most_links: int = 10) -> DataFrame:
    """rec_id, rule_id, detail: large modules, modules that depend on many, without regions, with client and server code,
    and forms that query or write the database themselves."""
    methods, calls = methods_of(code, key, path, text), call_graph(code, key, path, text)
    lines = code.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("rec_id"), F.col(path).alias("path"), F.split(F.col(text), r"\r\n|\n|\r").alias("ls"))
    n_methods = methods.groupBy("rec_id").agg(F.count(F.lit(1)).alias("methods"))
    links = calls.where(F.lower("caller_module") != F.lower("callee_module")).groupBy("rec_id").agg(F.count_distinct(F.lower("callee_module")).alias("links"))
    low = F.transform("ls", F.lower)
    facts = lines.select(
        "rec_id", F.size("ls").alias("lines"), F.col("path").contains(".Form.").alias("form"),
        F.exists(low, lambda x: x.rlike(r"^\s*#\s*(область|region)")).alias("regions"),
        F.exists(low, lambda x: x.rlike(r"^\s*&\s*(наклиенте|atclient)")).alias("client"), F.exists(low, lambda x: x.rlike(r"^\s*&\s*(насервере|atserver)")).alias("server"),
        F.filter(F.transform(low, lambda x, i: F.when(x.rlike(r"(новый\s+запрос|new\s+query)") & ~F.array_join(F.slice("ls", F.greatest(i - 5, F.lit(1)), F.least(i, F.lit(6))), "\n").rlike("(?iu)&\\s*насервере|&\\s*atserver"), i + 1)), lambda x: x.isNotNull()).alias("queries"),
        F.filter(F.transform(low, lambda x, i: F.when(x.rlike(r"\.(записать|удалить|write|delete)\s*\("), i + 1)), lambda x: x.isNotNull()).alias("writes"),
    ).join(n_methods, "rec_id", "left").join(links, "rec_id", "left")
    methods_n, links_n = F.coalesce("methods", F.lit(0)), F.coalesce("links", F.lit(0))
    rule = lambda test, name, detail: F.when(test, F.struct(F.lit(name).alias("rule_id"), detail.cast("string").alias("detail")))
    tests = [
        rule((F.col("lines") > most_lines) | (methods_n > most_methods), "ARCH004", F.col("lines")),
        rule(links_n > most_links, "ARCH006", links_n),
        rule((F.col("lines") > 20) & ~F.col("regions"), "ARCH007", F.col("lines")),
        rule(F.col("client") & F.col("server") & ~F.col("form"), "ARCH008", F.lit("")),
        rule(F.col("form") & (F.size("queries") > 0), "ARCH009", F.array_join("queries", ",")),
        rule(F.col("form") & (F.size("writes") > 0), "ARCH010", F.array_join("writes", ",")),
    ]
    return facts.select("rec_id", F.inline(F.filter(F.array(*tests), lambda x: x.isNotNull())))


# a literal that begins a query, to its closing quote; continuation bars of the lines inside come off
QUERY_LITERAL = r'(?iu)(?:запрос\.?текст|\.?текст|\.?text|query\.text|текстзапроса|querytext)\s*=\s*"((?:[^"]|"")*)"'
QUERY_BLOCK = r"(?isu)(?:^|\n)[ \t]*((?:выбрать|select)[ \t\n].*)$"


def query_texts(code: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line, query: the texts assigned as a query in source code, whatever their number of lines, in order."""
    found = F.regexp_extract_all(F.col(text), F.lit(QUERY_LITERAL), F.lit(0))
    at = code.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"), F.posexplode(found).alias("pos", "__m"))
    body = F.regexp_replace(F.replace(F.regexp_extract("__m", QUERY_LITERAL, 1), F.lit('""'), F.lit('"')), r"(\r\n|\n|\r)[ \t]*\|?", "\n")
    line = F.size(F.split(F.substring("__t", F.lit(1), F.position(F.col("__m"), F.col("__t"))), r"\r\n|\n|\r"))
    return at.select(key, (F.col("pos") + 1).alias("pos"), line.alias("line"), body.alias("query")).where(F.trim("query") != "")


def query_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, query: query texts that stand in prose or fenced blocks.  Texts fall into blocks at empty lines and fences;
    a block's query reaches from the line that begins with the keyword to the block's end."""
    blocks = F.split(F.regexp_replace(F.col(text), r"\r\n|\r", "\n"), r"\n[ \t]*\n|```")
    each = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(blocks).alias("__i", "__b"))
    return each.select(key, (F.col("__i") + 1).alias("pos"), F.regexp_extract("__b", QUERY_BLOCK, 1).alias("query")).where(F.lower("query").rlike(r"[\s](из|from)\s"))
