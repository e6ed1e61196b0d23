"""Declarative rules over source lines and query texts.

A line is first taken apart: its code with strings emptied and the comment cut off, the comment, the literals, the names it
calls, and the name and value of an assignment.  A rule is a row: id, severity, message and a condition on these parts, in
the few SQL functions that every engine has.  All rules are evaluated in one scan: each line yields an array of the rules it
breaks, and one ``inline`` emits the violations.  Query texts are brought to one spelling (English keywords, single blanks)
before their rules look at them.  Rules that look at neighbouring lines slice the file's array of lines; rules with a
running state go over a file once in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``when`` may use ``MATCH(text, 'pattern')`` and ``CALLS('name', ...)`` besides plain SQL."""

    id: str
    severity: str
    message: str
    when: str


# parts of a line: text, low (code in lower case), code, comment, note (comment in lower case), literals, literal (the first
# one), called (names called, in lower case between blanks), name, target (in lower case) and value of an assignment
LINE_RULES = [
    Rule("SEC001", "CRITICAL", "query text built by concatenation", r"MATCH(target, '(^|[.])(текст|text)$') AND MATCH(value, '^\"\"\s*[+]')"),
    Rule("SEC002", "CRITICAL", "dynamic execution", r"CALLS('выполнить', 'execute') AND NOT MATCH(low, '(выполнить|execute)\s*[(]\s*\"\"\s*[)]')"),
    Rule("SEC003", "HIGH", "dynamic evaluation", r"CALLS('вычислить', 'eval') AND NOT MATCH(low, '(вычислить|eval)\s*[(]\s*\"\"\s*[)]')"),
    Rule("SEC004", "CRITICAL", "password in code", r"MATCH(target, '(пароль|password)$') AND MATCH(value, '^\"\"') AND literal <> ''"),
    Rule("SEC005", "CRITICAL", "token in code", r"MATCH(target, '(токен|token|ключ|key)$') AND MATCH(literal, '^[A-Za-z0-9_-]{20,}$')"),
    Rule("SEC006", "HIGH", "COM object", r"MATCH(low, '(новый|new)\s+com(объект|object)')"),
    Rule("SEC007", "HIGH", "privileged mode", r"CALLS('установитьпривилегированныйрежим', 'setprivilegedmode') AND MATCH(low, '[(]\s*(истина|true)\s*[)]')"),
    Rule("SEC008", "HIGH", "application start", r"CALLS('запуститьприложение', 'runapp') AND NOT MATCH(low, '[(]\s*\"\"\s*[)]')"),
    Rule("SEC009", "MEDIUM", "file by a computed path", r"CALLS('копироватьфайл', 'переместитьфайл', 'удалитьфайлы', 'значениеизфайла', 'filecopy', 'movefile', 'deletefiles') AND NOT MATCH(low, '[(]\s*\"\"')"),
    Rule("SEC010", "MEDIUM", "connection without TLS", r"MATCH(lower(literals), 'http://') AND NOT MATCH(lower(literals), 'http://(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0)')"),
    Rule("SEC012", "HIGH", "unsafe deserialisation", r"CALLS('значениеизстрокивнутр', 'valuefromstringinternal')"),
    Rule("SEC013", "MEDIUM", "XML built by concatenation", r"MATCH(literals, '(^|\n)</?[A-Za-z]') AND MATCH(low, '\"\"\s*[+]|[+]\s*\"\"')"),
    Rule("SEC014", "LOW", "address in code", r"MATCH(literals, '(^|\n)([0-9]{1,3}[.]){3}[0-9]{1,3}(\n|$)') AND NOT MATCH(literals, '(^|\n)(127|0|255)[.]')"),
    Rule("SEC015", "MEDIUM", "weak hash", r"MATCH(low, '(хешфункция|hashfunction)[.](md5|crc32|sha1)(\W|$)')"),
    Rule("SEC018", "HIGH", "command line put together", r"CALLS('командасистемы', 'запуститьприложение', 'system', 'runapp') AND contains(low, '+')"),
    Rule("SEC-SSL", "MEDIUM", "HTTP connection without protection", r"MATCH(low, '(новый|new)\s+(httpсоединение|httpconnection)') AND NOT MATCH(low, 'защищенноесоединение|secureconnection|ssl')"),
    Rule("Q004", "CRITICAL", "concatenation beside a query text", r"contains(low, '+') AND MATCH(low, '(^|[.\s])(текст|text)(\W|$)')"),
    Rule("Q019", "LOW", "count compared to see whether anything is there", r"MATCH(low, '[.](количество|count)[(][)]\s*>\s*0')"),
    Rule("STD456-NBSP", "LOW", "non-breaking space", "MATCH(text, '\u00a0')"),
    Rule("STD456-DASH", "LOW", "long dash in code", "MATCH(text, '[–—]')"),
    Rule("STD456-YO", "LOW", "letter yo in code", "contains(low, 'ё')"),
    Rule("STD456-COMMENTED", "LOW", "commented-out code", r"trim(low) = '' AND (MATCH(note, ';\s*$') OR MATCH(note, '^\s*(если|иначеесли|if|elsif)\s.*(тогда|then)\s*$') OR MATCH(note, '^\s*(для|пока|for|while)\s.*(цикл|do)\s*$') OR MATCH(note, '^\s*(попытка|исключение|иначе|возврат|try|except|else|return)\s*$'))"),
    Rule("STD456-TODO", "LOW", "task mark without a number", r"MATCH(note, '^\s*(todo|fixme|hack|mrg|xxx)(\W|$)') AND NOT MATCH(note, '[№#]\s*[0-9]')"),
    Rule("STD456-AUTHOR", "LOW", "author mark", r"MATCH(comment, '^\s*[А-ЯЁ][а-яё]{2,20}\s*:') AND NOT MATCH(note, '^\s*(параметры|возвращает|описание|пример|примечание)\s*:')"),
    Rule("STD454-PREFIX", "LOW", "type prefix in a name", r"MATCH(name, '^(стр|чис|мас|бул|дат|м|с)[А-ЯЁ]')"),
    Rule("STD454-SHORT", "LOW", "one-letter variable", r"MATCH(low, '^\s*(перем|var)\s+[\p{L}]\s*;')"),
    Rule("STD454-UNDERSCORE", "LOW", "variable begins with an underscore", r"MATCH(low, '^\s*(перем|var|для|для\s+каждого|for|for\s+each)\s+_')"),
    Rule("STD456-LENGTH", "LOW", "line over 120 characters", "length(text) > 120"),
    Rule("STD547", "MEDIUM", "jump", r"MATCH(low, '^\s*(перейти|goto)\s')"),
    Rule("STD-JOURNAL", "LOW", "journal record", r"MATCH(text, '(ЗаписьЖурналаРегистрации|WriteLogEvent)\s*[(]')"),
    Rule("STD03-FULL", "MEDIUM", "full outer join", r"MATCH(lower(text), '(полное\s+(внешнее\s+)?соединение|full\s+(outer\s+)?join)')"),
    Rule("STD03-UNION", "LOW", "union that removes duplicates", r"MATCH(lower(text), '^\s*[|]\s*(объединить|union)\s*$')"),
    Rule("STD03-CASE", "LOW", "query keyword in lower case", r"MATCH(text, '^\s*[|]\s*(выбрать|из|где|сгруппировать|упорядочить|имеющие|select|from|where)(\s|$)')"),
    Rule("STD-DIALOG", "LOW", "dialog without check", "CALLS('показатьвопрос', 'показатьпредупреждение', 'showquerybox', 'showmessagebox')"),
    Rule("STD-QCONCAT", "HIGH", "query text changed in place", r"MATCH(target, '(запрос|query)[.](текст|text)$') AND MATCH(value, '[+]|^(стрзаменить|strreplace)')"),
    Rule("STD-NEGATIVE", "LOW", "negated boolean name", r"MATCH(code, '^\s*(Перем|Var)\s+(Не|Not)[А-ЯЁA-Z]')"),
    Rule("STD13-COM", "HIGH", "bypass over COM", r"MATCH(lower(text), '(comобъект|comobject|adodb[.])')"),
    Rule("STD686", "MEDIUM", "cancel flag reset", r"target IN ('отказ', 'cancel') AND MATCH(value, '^(ложь|false)')"),
    Rule("STD-PSEUDO", "LOW", "pseudo region", r"MATCH(note, '^\s*[-=#*]{2,}\s*(область|region|конец|---)')"),
    Rule("STD-GLOBAL", "LOW", "variable named as a global object", r"target IN ('справочники', 'документы', 'метаданные', 'перечисления', 'константы', 'catalogs', 'documents', 'metadata', 'enums', 'constants')"),
    Rule("STD-INDENT", "LOW", "indent of blanks", r"MATCH(text, '^ +[^ ]')"),
    Rule("STD456-MULTI", "LOW", "several statements on a line", r"MATCH(low, ';\s*[^\s;].*;')"),
    Rule("STD-FIND", "LOW", "search by column with Find", r"MATCH(low, '[.](найти|find)\s*[(][^,()]+,\s*\"\"')"),
    Rule("STD456-SPACE", "LOW", "no blank after comment mark", r"MATCH(comment, '^[^\s/]')"),
    Rule("STD438", "MEDIUM", "unload to test for emptiness", r"contains(low, '.выгрузить()') AND MATCH(low, '(количество[(][)]\s*=\s*0|пустая)')"),
    Rule("STD442", "MEDIUM", "type compared by metadata name", r"MATCH(low, '[.]\s*метаданные\s*[(]\s*[)]\s*[.]\s*имя\s*=')"),
    Rule("STD639", "MEDIUM", "exported module variable", r"MATCH(low, '^\s*(перем|var)\s.*\s(экспорт|export)\s*;')"),
    Rule("STD693", "LOW", "long structure constructor", r"MATCH(low, '(новый|new)\s+(структура|structure)\s*[(]\s*\"\"') AND length(literal) >= 50"),
    Rule("STD643", "MEDIUM", "server date instead of session date", "CALLS('текущаядата', 'currentdate')"),
    Rule("ARC-MESSAGE", "LOW", "message to the user without a key", r"MATCH(text, 'Сообщить\s*[(]') OR CALLS('message')"),
    Rule("ARC-TERNARY", "LOW", "ternary operator", r"MATCH(low, '[?]\s*[(]')"),
    Rule("ARC-BOOLEAN", "LOW", "comparison with a boolean", r"MATCH(low, '=\s*(истина|ложь|true|false)')"),
    Rule("ARC-YODA", "LOW", "constant on the left", r"MATCH(low, '^\s*(если|if)\s+(\"\"|[0-9]+)\s*=')"),
    Rule("ARC-MAGIC", "LOW", "magic number", r"MATCH(low, '[=<>(+*/,-]\s*([2-9][0-9]{2,}|[1-9][0-9]{3,})([^0-9.]|$)')"),
    Rule("ARC-DOTS", "LOW", "attribute read over three stops", r"MATCH(low, '[\p{L}_]+[.][\p{L}_]+[.][\p{L}_]+[.][\p{L}_]+\s*(;|$|[^(\p{L}_.])')"),
    Rule("ARC-CREDENTIAL", "HIGH", "credential by its name", r"MATCH(lower(literals), '(^|\n)(пароль|password|токен|token|secret|api_?key)(\n|$)') AND MATCH(low, '\"\"\s*,\s*\"\"')"),
    Rule("BSL-SELF", "MEDIUM", "assignment to itself", "target <> '' AND value = concat(target, ';')"),
    Rule("BSL-PARAMS", "LOW", "more than seven parameters", r"MATCH(low, '^\s*(процедура|функция|procedure|function)\s') AND length(low) - length(replace(low, ',', '')) >= 7"),
    Rule("BSL-NAME", "LOW", "name over 50 characters", r"MATCH(low, '^\s*(процедура|функция|procedure|function)\s+[\p{L}\p{N}_]{51}')"),
    Rule("BSL-MODAL", "MEDIUM", "modal call", "CALLS('вопрос', 'предупреждение', 'открытьформумодально', 'ввестизначение', 'doquerybox', 'domessagebox')"),
    Rule("BSL-COMMENT", "LOW", "comment over 120 characters", "length(comment) > 120"),
    Rule("BSL-EQUAL", "LOW", "no blanks around the equals sign", r"MATCH(code, '[\p{L}\p{N}_]=|=[\p{L}\p{N}_\"]')"),
    Rule("BSL-TEMPFILE", "LOW", "temporary file to be removed", "CALLS('получитьимявременногофайла', 'gettempfilename')"),
    Rule("BSL-DEPRECATED", "LOW", "deprecated method", "CALLS('найтипометкой', 'сокрп', 'открытьформумодально', 'получитьформу')"),
    Rule("DX007", "MEDIUM", "path of an exchange file in code", r"MATCH(literals, '(^|\n)([A-Za-z]:[/\\]|/[A-Za-z]+/)')"),
    Rule("DX009", "MEDIUM", "internal serialisation", "CALLS('значениевстрокувнутр', 'valuetostringinternal')"),
]

# parts of a query: raw (as it stands) and q (one spelling: strings emptied, lower case, English keywords, blanks around signs)
QUERY_RULES = [
    Rule("Q001", "MEDIUM", "all fields selected", "contains(q, ' select * ')"),
    Rule("Q002", "MEDIUM", "no condition", "contains(q, ' from ') AND NOT contains(q, ' where ')"),
    Rule("Q003", "LOW", "literal instead of a parameter", r"NOT contains(q, '&') AND MATCH(q, ' where .*[=<>] (\"\"|[0-9])')"),
    Rule("Q005", "HIGH", "pattern begins with a percent sign", r"MATCH(lower(raw), '(подобно|like)\s+\"%')"),
    Rule("Q006", "MEDIUM", "subquery in the field list", "instr(q, '( select ') > 0 AND instr(q, '( select ') < instr(q, ' from ')"),
    Rule("Q007", "HIGH", "function over a column in a condition", r"MATCH(q, ' where .*(подстрока|substring|год|year|месяц|month|нрег|lower|врег|upper|началопериода|beginofperiod) [(]')"),
    Rule("Q008", "LOW", "join without grouping", "contains(q, ' join ') AND NOT contains(q, ' distinct ') AND NOT contains(q, ' group ')"),
    Rule("Q009", "HIGH", "join without condition", "(length(q) - length(replace(q, ' join ', ''))) / 6 > (length(q) - length(replace(q, ' on ', ''))) / 4"),
    Rule("Q010", "MEDIUM", "temporary table without index", "contains(q, ' into ') AND NOT contains(q, ' index ')"),
    Rule("Q011", "MEDIUM", "long chain of references", r"MATCH(q, ' [\p{L}\p{N}_]+[.][\p{L}\p{N}_]+[.][\p{L}\p{N}_]+[.][\p{L}\p{N}_]+') AND NOT contains(q, ' cast ')"),
    Rule("Q012", "HIGH", "join with a virtual table", r"MATCH(q, ' join [^ ]+[.](остатки|обороты|остаткииобороты|срезпоследних|срезпервых|balance|turnovers|balanceandturnovers|slicelast|slicefirst) ')"),
    Rule("Q013", "MEDIUM", "OR in a join condition", "contains(joined, ' or ')"),
    Rule("Q014", "LOW", "odd number of quotes", """(length(raw) - length(replace(raw, '"', ''))) % 2 = 1"""),
    Rule("Q015", "LOW", "left join without a test for null", "contains(q, ' left ') AND NOT contains(q, ' isnull ') AND NOT contains(q, ' is null ') AND NOT contains(q, ' is not null ')"),
    Rule("Q016", "HIGH", "virtual table without parameters", r"contains(q, ' where ') AND MATCH(q, '[.](остатки|обороты|остаткииобороты|срезпоследних|срезпервых|balance|turnovers|slicelast|slicefirst) [(] (&[\p{L}\p{N}_]+ )?(, )*[)]')"),
    Rule("Q017", "LOW", "field without a name", "fields <> '' AND NOT contains(fields, '(') AND NOT contains(fields, '*') AND length(fields) - length(replace(fields, ',', '')) + 1 > (length(fields) - length(replace(fields, ' as ', ''))) / 4"),
    Rule("Q018", "LOW", "union that removes duplicates", "length(q) - length(replace(q, ' union ', '')) > (length(q) - length(replace(q, ' union all ', ''))) / 11 * 7"),
    Rule("O001", "HIGH", "first rows without order", "contains(q, ' top ') AND NOT contains(q, ' order ')"),
    Rule("O002", "MEDIUM", "OR in the condition", "contains(condition, ' or ')"),
    Rule("O003", "MEDIUM", "full join", "contains(q, ' full ')"),
    Rule("O004", "HIGH", "join with a subquery", "contains(q, ' join ( ')"),
]
QUERY_RULES += [Rule(new, severity, r.message, r.when) for old, new, severity in (("Q016", "O005", "HIGH"), ("Q011", "O006", "LOW"), ("Q010", "O007", "MEDIUM"), ("Q018", "O008", "LOW")) for r in QUERY_RULES if r.id == old]

# fixed values: keywords of queries that rules ask for, English <- Russian
QUERY_WORDS = {
    "select": "выбрать", "distinct": "различные", "top": "первые", "into": "поместить", "from": "из", "as": "как", "where": "где", "join": "соединение", "left": "левое", "full": "полное", "on": "по",
    "group": "сгруппировать", "order": "упорядочить", "union": "объединить", "all": "все", "index": "индексировать", "or": "или", "cast": "выразить", "isnull": "естьnull", "is null": "есть null", "is not null": "есть не null",
}


def condition(rule: Rule, match: str = "regexp_like") -> str:
    """The rule's condition in plain SQL; ``match`` is the engine's function for patterns."""
    calls = lambda m: "(" + " OR ".join(f"contains(called, ' {n.strip()[1:-1]} ')" for n in m[1].split(",")) + ")"
    return re.sub(r"CALLS\(([^()]*)\)", calls, rule.when).replace("MATCH(", f"{match}(")


def _test(rule: Rule) -> Column:
    return F.expr(condition(rule).replace("\\", "\\\\"))  # a string literal of Spark's parser takes one escape


def _violations(rules: list[Rule]) -> Column:
    """Array of (rule_id, severity, message) that the parts of a line or query break."""
    tests = [F.when(_test(r), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def source_lines(code: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), text of every source line."""
    return code.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("i", "text")).select(key, (F.col("i") + 1).alias("line"), "text")


def line_parts(lines: DataFrame) -> DataFrame:
    """The parts of ``text`` that rules look at, beside the other columns."""
    blanked = F.regexp_replace("text", '"[^"]*"', '""')
    code = F.substring_index(blanked, "//", 1)
    comment = F.substring(blanked, F.length(code) + 3, F.length(blanked))
    literals = F.regexp_extract_all("text", F.lit('"([^"]*)"'), F.lit(1))
    first = lines.withColumns({"code": code, "comment": comment, "literals": F.array_join(literals, "\n"), "literal": F.coalesce(F.get(literals, F.lit(0)), F.lit(""))})
    low = first.withColumns({"low": F.lower("code"), "note": F.lower("comment"), "name": F.regexp_extract("code", r"^\s*([\p{L}\p{N}_.]+)\s*=", 1)})
    names = F.regexp_extract_all("low", F.lit(r"([\p{L}_][\p{L}\p{N}_.]*)\s*[(]"), F.lit(1))
    return low.withColumns({"called": F.concat(F.lit(" "), F.array_join(names, " "), F.lit(" ")), "target": F.lower("name"), "value": F.trim(F.regexp_extract("low", r"^[^=]*=\s*(.*)$", 1))})


def check_lines(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """lines and the rules they break: ..., rule_id, severity, message."""
    return line_parts(lines).select(*[c for c in lines.columns if c != "text"], F.inline(_violations(rules or LINE_RULES)))


def query_parts(queries: DataFrame, text: str) -> DataFrame:
    """The parts of a query text that rules look at, beside the other columns."""
    q = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"//[^\r\n]*", " "), '"[^"]*"', '""')
    q = F.regexp_replace(F.regexp_replace(q, r"([(),;=<>+*/])", r" $1 "), r"\s+", " ")
    q = F.concat(F.lit(" "), F.trim(q), F.lit(" "))
    for english, russian in QUERY_WORDS.items():
        q = F.replace(q, F.lit(f" {russian} "), F.lit(f" {english} "))
    staged = queries.withColumn("raw", F.col(text)).withColumn("q", q)
    return staged.withColumns(
        {
            "joined": F.regexp_extract("q", r" join .* on (.*?)( where | group | order | union |$)", 1), "condition": F.regexp_extract("q", r" where (.*?)( group | order | union |$)", 1),
            "fields": F.regexp_extract("q", r"^ select (distinct |top [0-9]+ )*(.*?) (from|into) ", 2),
        }
    )


def check_queries(queries: DataFrame, key: str, text: str, rules: list[Rule] | None = None) -> DataFrame:
    """key and the rules its query text breaks (case does not matter); other columns of ``queries`` stay."""
    kept = [c for c in queries.columns if c != text]
    return query_parts(queries.where(F.col(text).isNotNull()), text).select(*kept, F.inline(_violations(rules or QUERY_RULES)))


def lines_sql(source: str) -> str:
    """The check of ``LINE_RULES`` in the SQL of DuckDB, over a query that gives module_id, line and text."""
    parts = f"""WITH l0 AS ({source}), l1 AS (SELECT *, regexp_replace(text, '"[^"]*"', '""', 'g') AS b, regexp_extract_all(text, '"([^"]*)"', 1) AS lits FROM l0),
 l2 AS (SELECT *, split_part(b, '//', 1) AS code, substr(b, length(split_part(b, '//', 1)) + 3) AS comment, array_to_string(lits, chr(10)) AS literals, coalesce(lits[1], '') AS literal FROM l1),
 l3 AS (SELECT *, lower(code) AS low, lower(comment) AS note, regexp_extract(code, '^\\s*([\\p{{L}}\\p{{N}}_.]+)\\s*=', 1) AS name FROM l2),
 l4 AS (SELECT *, ' ' || array_to_string(regexp_extract_all(low, '([\\p{{L}}_][\\p{{L}}\\p{{N}}_.]*)\\s*[(]', 1), ' ') || ' ' AS called, lower(name) AS target, trim(regexp_extract(low, '^[^=]*=\\s*(.*)$', 1)) AS value FROM l3)"""
    tests = " UNION ALL ".join(f"SELECT module_id, line, '{r.id}' AS rule_id, '{r.severity}' AS severity, '{r.message}' AS message FROM l4 WHERE {condition(r, 'regexp_matches')}" for r in LINE_RULES)
    return f"{parts} SELECT * FROM ({tests})"


def queries_sql(source: str) -> str:
    """The check of ``QUERY_RULES`` in the SQL of DuckDB, over a query that gives src, rec_id, pos and query."""
    q = "lower(query)"
    q = f"""regexp_replace(regexp_replace({q}, '//[^\\r\\n]*', ' ', 'g'), '"[^"]*"', '""', 'g')"""
    q = f"""regexp_replace(regexp_replace({q}, '([(),;=<>+*/])', ' \\1 ', 'g'), '\\s+', ' ', 'g')"""
    q = f"' ' || trim({q}) || ' '"
    for english, russian in QUERY_WORDS.items():
        q = f"replace({q}, ' {russian} ', ' {english} ')"
    parts = f"""WITH q0 AS ({source}), q1 AS (SELECT *, query AS raw, {q} AS q FROM q0),
 q2 AS (SELECT *, regexp_extract(q, ' join .* on (.*?)( where | group | order | union |$)', 1) AS joined, regexp_extract(q, ' where (.*?)( group | order | union |$)', 1) AS condition, regexp_extract(q, '^ select (distinct |top [0-9]+ )*(.*?) (from|into) ', 2) AS fields FROM q1)"""
    tests = " UNION ALL ".join(f"SELECT src, rec_id, pos, '{r.id}' AS rule_id FROM q2 WHERE {condition(r, 'regexp_matches')}" for r in QUERY_RULES)
    return f"{parts} SELECT * FROM ({tests})"


# fixed values: look-back rules (identifier, severity, message, pattern, lines before, what must stand in them)
CONTEXT_RULES = [
    ("SEC011", "MEDIUM", "write without a check of rights", r"\.Записать\s*\(\s*\)", 5, r"ПравоДоступа|РольДоступна|ПроверитьПраво"),
    ("STD-PRIV", "MEDIUM", "privileged mode without a reason", r"ПривилегированныйРежим\s*\(", 1, r"//"),
    ("STD-DOC", "LOW", "exported method without documentation", r"(Процедура|Функция)\s+\S+.*Экспорт", 1, r"^\s*(//|&)"),
]


def check_context(code: DataFrame, key: str, text: str) -> DataFrame:
    """Violations of rules about the lines before: key, line, rule_id, severity, message."""
    staged = code.where(F.col(text).isNotNull()).select(key, F.split(F.col(text), r"\r\n|\n|\r").alias("ls"))

    def judge(line: Column, i: Column) -> Column:
        tests = []
        for rule, severity, message, pattern, back, need in CONTEXT_RULES:
            start = F.greatest(i - back, F.lit(0))
            before = F.array_join(F.slice(F.col("ls"), start + 1, i - start), "\n")
            tests.append(F.when(line.rlike(pattern) & ~before.rlike("(?m)" + need), F.struct((i + 1).alias("line"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))))
        return F.filter(F.array(*tests), lambda x: x.isNotNull())

    return staged.select(key, F.inline(F.flatten(F.transform("ls", judge))))


_BEGIN, _COMMIT, _ROLLBACK = (re.compile(p, re.I) for p in (r"\b(?:НачатьТранзакцию|BeginTransaction)\s*\(", r"\b(?:ЗафиксироватьТранзакцию|CommitTransaction)\s*\(", r"\b(?:ОтменитьТранзакцию|RollbackTransaction)\s*\("))
_LOOP, _END_LOOP = re.compile(r"^\s*(?:Для|Пока|For|While)\s", re.I), re.compile(r"^\s*(?:КонецЦикла|EndDo)\b", re.I)
_METHOD, _END_METHOD = re.compile(r"^\s*(?:Асинх\s+|Async\s+)?(?:Процедура|Функция|Procedure|Function)\s+(\w+)", re.I), re.compile(r"^\s*(?:КонецПроцедуры|КонецФункции|EndProcedure|EndFunction)\b", re.I)
_REGION, _END_REGION = re.compile(r"^\s*#\s*(?:Область|Region)\b", re.I), re.compile(r"^\s*#\s*(?:КонецОбласти|EndRegion)\b", re.I)
_OPEN, _CLOSE = re.compile(r"^\s*(?:Если|Для|Пока|Попытка|If|For|While|Try)\b", re.I), re.compile(r"^\s*(?:КонецЕсли|КонецЦикла|КонецПопытки|EndIf|EndDo|EndTry)\b", re.I)


def stateful(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, rule, severity, message) of rules that carry a state through a file."""
    depth = loop = regions = tx = 0
    begun = written = committed = 0
    names: dict[str, int] = {}
    returned, current = False, None
    for n, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
        code = line.split("//")[0]
        if not code.strip():
            continue
        if _BEGIN.search(code):
            begun += 1
            tx += 1
            if tx > 1:
                yield n, "TX005", "HIGH", "nested transaction"
        if _COMMIT.search(code) or _ROLLBACK.search(code):
            committed += 1
            tx = max(0, tx - 1)
        if tx and re.search(r"(?:Вопрос|ПоказатьВопрос|ПоказатьПредупреждение|Предупреждение)\s*\(", code):
            yield n, "TX003", "HIGH", "dialog inside a transaction"
        if _LOOP.search(code):
            loop += 1
        if loop and re.search(r"Новый\s+Запрос|New\s+Query", code, re.I):
            yield n, "ARC-QLOOP", "CRITICAL", "query inside a loop"
        if loop and re.search(r"\.Записать\s*\(", code):
            written += 1
            yield n, "TX009", "MEDIUM", "record written inside a loop"
        if _END_LOOP.search(code):
            loop = max(0, loop - 1)
        if _OPEN.search(code):
            depth += 1
            if depth == 6:
                yield n, "STD-NESTING", "MEDIUM", "nested deeper than five levels"
        if _CLOSE.search(code):
            depth = max(0, depth - 1)
        regions += bool(_REGION.search(code)) - bool(_END_REGION.search(code))
        if (m := _METHOD.search(code)) and not code.lstrip().startswith("|"):
            low = m[1].lower()
            if low in names:
                yield n, "BSL-DUPLICATE", "HIGH", "method defined twice"
            names[low] = n
            current, returned = (n if re.search(r"Функция|Function", code, re.I) else None), False
            if not regions:
                yield n, "STD455", "LOW", "method outside of regions"
        if re.search(r"\b(?:Возврат|Return)\b", code, re.I):
            returned = True
        if _END_METHOD.search(code):
            if current and not returned:
                yield current, "BSL-RETURN", "HIGH", "function without a return"
            current, depth, loop = None, 0, 0
    if begun != committed:
        yield 1, "TX001", "CRITICAL", "transactions begun and ended do not match"
    if regions:
        yield 1, "STR-REGION", "MEDIUM", "regions are not balanced"


def check_stateful(code: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, rule_id, severity, message; files are judged one by one."""
    kind = code.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *v) for k, t in zip(b[key], b[text]) if isinstance(t, str) for v in stateful(t)]
            yield pd.DataFrame(rows, columns=[key, "line", "rule_id", "severity", "message"])

    return code.select(key, text).mapInPandas(run, f"`{key}` {kind}, line int, rule_id string, severity string, message string")


# fixed values: intents of a request (name, base confidence, pattern)
INTENTS = [
    ("query", 0.9, r"(?iu)запрос|выбрать|select|выборк"), ("report", 0.85, r"(?iu)отч[её]т|report|скд"), ("fix", 0.85, r"(?iu)ошибк|исправ|error|fix|bug"),
    ("explain", 0.8, r"(?iu)объясн|почему|зачем|explain|why"), ("generate", 0.8, r"(?iu)созда|напиши|сгенерир|create|generate"), ("search", 0.8, r"(?iu)найти|найди|поиск|где |search|find"),
    ("optimize", 0.85, r"(?iu)оптимиз|ускор|медленн|optimi[sz]e|slow"), ("exchange", 0.75, r"(?iu)обмен|выгруз|загруз|exchange|import"), ("rights", 0.75, r"(?iu)прав[ао]|роль|доступ|rights|permission"),
]


def classify_intent(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, intent, confidence: the strongest intent; each match beyond the first adds 0.05, at most 1."""
    scored = F.array(
        *(F.struct(F.when(F.regexp_count(F.col(text), F.lit(p)) > 0, F.least(F.lit(1.0), F.lit(c) + 0.05 * (F.regexp_count(F.col(text), F.lit(p)) - 1))).alias("c"), F.lit(n).alias("n")) for n, c, p in INTENTS)
    )
    best = F.array_max(F.filter(scored, lambda x: x["c"].isNotNull()))
    return df.where(F.col(text).isNotNull()).select(key, F.coalesce(best["n"], F.lit("unknown")).alias("intent"), F.round(F.coalesce(best["c"], F.lit(0.0)), 4).alias("confidence"))


# -- rules over whole methods and over files of metadata
# fixed values: what a method of a module may be about (words of its name), for the context rules below
CLIENT, SERVER = r"(?i)^\s*&\s*(?:наклиенте|atclient)\b", r"(?i)^\s*&\s*насервере|^\s*&\s*atserver"
_DB = re.compile(r"(?:новый\s+запрос|new\s+query|\.(?:записать|прочитать|удалить|write|read|delete)\s*\(|справочники\.|документы\.|catalogs\.|documents\.)", re.I)
_HANDLER = re.compile(r"^(?:передзаписью|призаписи|передудалением|обработкапроведения|обработкаудаленияпроведения|beforewrite|onwrite|beforedelete|posting)", re.I)


def method_findings(method: dict, lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
    """(line, rule, severity, message) of rules that look at one method as a whole: where it runs, what it holds, how long
    it is.  ``method`` comes from the reader of methods, ``lines`` are those of its file."""
    first, last = method["line"], method["last_line"]
    body = [(n, lines[n - 1].split("//")[0]) for n in range(first + 1, last)]
    full = [(n, x) for n, x in body if x.strip()]
    low = "\n".join(x for _, x in body).lower()
    where = (method["directive"] or "").lower()
    at = lambda pattern: next((n for n, x in body if re.search(pattern, x, re.I)), None)
    if where.startswith(("наклиенте", "atclient")):
        if n := at(r"начатьтранзакцию\s*\(|begintransaction\s*\("):
            yield n, "CS001", "HIGH", "transaction on the client"
        if n := next((n for n, x in body if _DB.search(x)), None):
            yield n, "CS002", "HIGH", "database used on the client"
    if where.startswith(("насервере", "atserver")) and (n := at(r"оповеститьобизменении\s*\(|notifychanged\s*\(")):
        yield n, "CS010", "LOW", "notification sent on the server"
    if method["exported"] and (method["region"] or "").lower() not in ("программныйинтерфейс", "служебныйпрограммныйинтерфейс", "public", "internal"):
        yield first, "CS006", "LOW", "exported method outside of the interface's region"
    if len(full) == 0:
        yield first, "AST-EMPTY", "LOW", "empty method"
    if len(full) > 50:
        yield first, "AST-LONG", "MEDIUM", "method over fifty lines"
    if sum(bool(re.match(r"\s*(?:возврат|return)\b", x, re.I)) for _, x in full) > 3:
        yield first, "AST-RETURNS", "LOW", "more than three returns"
    if len(method["params"]) > 5:
        yield first, "MET-PARAMS", "LOW", "more than five parameters"
    opened = at(r"начатьтранзакцию\s*\(|begintransaction\s*\(")
    closed = at(r"(?:зафиксировать|отменить)транзакцию\s*\(|(?:commit|rollback)transaction\s*\(")
    if opened:
        after = "\n".join(x for n, x in body if opened <= n <= opened + 10).lower()
        if not re.search(r"попытка|\btry\b", after):
            yield opened, "TX002", "HIGH", "transaction without an attempt around it"
        if closed and closed - opened > 100:
            yield opened, "TX004", "MEDIUM", "transaction over a hundred lines"
        if re.search(r"\.остатки\s*\(|\.balance\s*\(", after) and not re.search(r"для\s+изменения|for\s+update|блокировкаданных|datalock", after):
            yield opened, "TX011", "MEDIUM", "balances read in a transaction without a lock"
    elif sum(bool(re.search(r"\.(?:записать|write)\s*\(", x, re.I)) for _, x in full) > 3:
        yield first, "TX006", "MEDIUM", "several records written without a transaction"
    if _HANDLER.match(method["method"]):
        head = "\n".join(x for _, x in full[:5]).lower()
        if not re.search(r"обменданными\s*\.\s*загрузка|dataexchange\s*\.\s*load", head):
            yield first, "DX001", "HIGH", "handler without a check for data exchange"
        if re.search(r"константы\.\w+\.установить|constants\.\w+\.set", low):
            yield at(r"константы\.|constants\.") or first, "TX007", "MEDIUM", "constant written in a handler"
    elif n := at(r"зарегистрироватьизменения\s*\(|recordchanges\s*\("):
        yield n, "DX005", "MEDIUM", "changes registered outside of a handler"
    if (n := at(r"\.получитьобъект\s*\(\s*\)|\.getobject\s*\(\s*\)")) and not re.search(r"\.записать\s*\(|\.write\s*\(", low):
        yield n, "TX010", "LOW", "whole object read without being written"
    elif n and not re.search(r"\.заблокировать\s*\(|\.lock\s*\(", low):
        yield n, "TX008", "MEDIUM", "object changed without a lock"
    if (n := at(r"(?<![.\w])(?:выполнить|вычислить|execute|eval)\s*\(")) and not re.search(r"безопасныйрежим|safemode", low):
        yield n, "SEC017", "HIGH", "dynamic code without the safe mode"
    if (n := at(r"(?:word|excel)\.application")) and "disableautomacros" not in low:
        yield n, "SEC019", "MEDIUM", "office application with its macros"
    if (n := at(r"внешние(?:обработки|отчеты)\.создать\s*\(|external(?:dataprocessors|reports)\.create\s*\(")) and "безопасн" not in low:
        yield n, "SEC020", "HIGH", "external code loaded"
    if (n := at(r"(?:новый|new)\s+(?:http|ftp)(?:соединение|connection)|(?:новый|new)\s+wsпрокси")) and not re.search(r",\s*\d{1,4}\s*[,)]|таймаут|timeout", low):
        yield n, "SEC016", "LOW", "connection without a timeout"
    depth = 0
    for n, x in body:
        if re.match(r"\s*(?:для|пока|for|while)\b", x, re.I):
            depth += 1
        if depth and re.search(r"\b(\w+)\s*=\s*\1\s*\+\s*\"", x):
            yield n, "STD782", "LOW", "string put together in a loop"
        if depth and re.search(r"насервере\s*\(|atserver\s*\(", x, re.I):
            yield n, "CS003", "HIGH", "server called in a loop"
        if re.match(r"\s*(?:конеццикла|enddo)\b", x, re.I):
            depth = max(0, depth - 1)


def check_methods(code: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, line, rule_id, severity, message of the rules over whole methods, and of the balance of a file's structure."""
    from ledgerloom.operators.code import read_methods

    pairs = (("Процедура Procedure", "КонецПроцедуры EndProcedure", "STR-PROCEDURE"), ("Функция Function", "КонецФункции EndFunction", "STR-FUNCTION"), ("Если If", "КонецЕсли EndIf", "STR-IF"), ("Для Пока For While", "КонецЦикла EndDo", "STR-LOOP"), ("Попытка Try", "КонецПопытки EndTry", "STR-TRY"))
    counts = [(re.compile(rf"^\s*(?:{'|'.join(a.split())})\b", re.I), re.compile(rf"^\s*(?:{'|'.join(b.split())})\b", re.I), rule) for a, b, rule in pairs]
    kind = code.schema[key].dataType.simpleString()

    def judge(t: str) -> Iterator[tuple]:
        lines = re.split(r"\r\n|\n|\r", t)
        for opening, closing, rule in counts:
            if sum(bool(opening.match(x)) for x in lines) != sum(bool(closing.match(x)) for x in lines):
                yield 1, rule, "MEDIUM", "structure is not balanced"
        held: list[int] = []
        for n, x in enumerate(lines, 1):
            if re.match(r"\s*#\s*(?:область|region)\b", x, re.I):
                held.append(n)
            elif re.match(r"\s*#\s*(?:конецобласти|endregion)\b", x, re.I) and held:
                start = held.pop()
                if not any(y.strip() and not y.lstrip().startswith("//") for y in lines[start : n - 1]):
                    yield start, "STR-EMPTY", "LOW", "empty region"
        for m in read_methods(t):
            yield from method_findings(m, lines)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *v) for k, t in zip(b[key], b[text]) if isinstance(t, str) for v in judge(t)], columns=[key, "line", "rule_id", "severity", "message"])

    return code.select(key, text).mapInPandas(run, f"`{key}` {kind}, line int, rule_id string, severity string, message string")


# conditions over a table of metadata objects (type, name, synonym, comment, properties map, children array)
METADATA_RULES = [
    Rule("empty-vendor", "warning", "no vendor", "type = 'Configuration' AND coalesce(properties['Vendor'], '') = ''"),
    Rule("empty-version", "warning", "no version", "type = 'Configuration' AND coalesce(properties['Version'], '') = ''"),
    Rule("empty-name-prefix", "warning", "no prefix of names", "type = 'Configuration' AND coalesce(properties['NamePrefix'], '') = ''"),
    Rule("empty-compatibility-mode", "warning", "no compatibility mode", "type = 'Configuration' AND coalesce(properties['CompatibilityMode'], '') = ''"),
    Rule("non-russian-script", "warning", "script variant is not Russian", "type = 'Configuration' AND coalesce(properties['ScriptVariant'], '') NOT IN ('', 'Russian')"),
    Rule("empty-synonym", "warning", "no synonym", "type <> 'Configuration' AND coalesce(synonym, '') = ''"),
    Rule("name-with-spaces", "error", "name with blanks", "contains(name, ' ')"),
    Rule("name-starts-with-digit", "error", "name begins with a digit", "MATCH(name, '^[0-9]')"),
    Rule("catalog-no-check-unique", "warning", "codes are not checked to be unique", "type = 'Catalog' AND coalesce(properties['CheckUnique'], 'false') <> 'true'"),
    Rule("catalog-no-list-form", "warning", "no form of the list", "type = 'Catalog' AND coalesce(properties['DefaultListForm'], '') = ''"),
    Rule("catalog-no-object-form", "warning", "no form of the object", "type = 'Catalog' AND coalesce(properties['DefaultObjectForm'], '') = ''"),
    Rule("module-no-comment", "warning", "module without a comment", "type = 'CommonModule' AND coalesce(comment, '') = ''"),
    Rule("module-no-synonym", "warning", "module without a synonym", "type = 'CommonModule' AND coalesce(synonym, '') = ''"),
    Rule("module-client-no-suffix", "warning", "client module without its suffix", "type = 'CommonModule' AND properties['ClientManagedApplication'] = 'true' AND coalesce(properties['Server'], 'false') <> 'true' AND NOT MATCH(name, '(Клиент|Client)$')"),
    Rule("module-servercall-no-suffix", "warning", "module for calls from the client without its suffix", "type = 'CommonModule' AND properties['ServerCall'] = 'true' AND NOT MATCH(name, '(ВызовСервера|ServerCall)$')"),
    Rule("module-server-no-suffix", "warning", "server module for both sides without its suffix", "type = 'CommonModule' AND properties['Server'] = 'true' AND properties['ClientManagedApplication'] = 'true' AND NOT MATCH(name, '(КлиентСервер|ClientServer)$')"),
    Rule("document-no-list-form", "warning", "no form of the list", "type = 'Document' AND coalesce(properties['DefaultListForm'], '') = ''"),
    Rule("document-no-check-unique", "warning", "numbers are not checked to be unique", "type = 'Document' AND coalesce(properties['CheckUnique'], 'false') <> 'true'"),
]


def check_metadata(objects: DataFrame) -> DataFrame:
    """type, name and the rules a metadata object breaks."""
    return objects.where("error IS NULL").select("type", "name", F.inline(_violations(METADATA_RULES)))


# conditions over a form summed up: items, depth, groups, fields, unnamed, untitled, tables, buttons, unbound, duplicates
FORM_RULES = [
    Rule("FQ001", "LOW", "empty form", "items = 0"),
    Rule("FQ002", "HIGH", "two items of one name", "duplicates > 0"),
    Rule("FQ003", "MEDIUM", "item without a name", "unnamed > 0"),
    Rule("FQ004", "MEDIUM", "nested deeper than five levels", "depth > 5"),
    Rule("FQ005", "MEDIUM", "more than a hundred items", "items > 100"),
    Rule("FQ006", "LOW", "many fields and no group", "fields > 10 AND groups = 0"),
    Rule("FQ008", "HIGH", "field bound to nothing", "unbound > 0"),
    Rule("FQ009", "LOW", "more than twenty buttons", "buttons > 20"),
    Rule("FQ010", "MEDIUM", "more than five tables", "tables > 5"),
]


def check_forms(items: DataFrame) -> DataFrame:
    """path and the rules a form breaks; ``items`` come from the scan of forms."""
    is_kind = lambda *names: F.count(F.when(F.col("kind").isin(*names), 1))
    per = items.groupBy("path").agg(
        F.count("kind").alias("items"), F.max(F.col("depth") + 1).alias("depth"), is_kind("UsualGroup", "Pages", "Page").alias("groups"), is_kind("InputField", "CheckBoxField", "LabelField").alias("fields"),
        F.count(F.when(F.coalesce("name", F.lit("")) == "", 1)).alias("unnamed"), is_kind("Table").alias("tables"), is_kind("Button").alias("buttons"),
        F.count(F.when(F.col("kind").isin("InputField", "CheckBoxField") & F.col("data_path").isNull(), 1)).alias("unbound"), (F.count(F.nullif("name", F.lit(""))) - F.count_distinct(F.nullif("name", F.lit("")))).alias("duplicates"),
    )
    return per.select("path", F.inline(_violations(FORM_RULES)))


# conditions over a report schema summed up: fields, untitled, calculated, totals, foreign_totals, sets, stars
SCHEMA_RULES = [
    Rule("SKD001", "MEDIUM", "no data set", "sets = 0"),
    Rule("SKD003", "LOW", "field without a title", "untitled > 0"),
    Rule("SKD004", "LOW", "no totals", "totals = 0"),
    Rule("SKD005", "MEDIUM", "more than fifty fields", "fields > 50"),
    Rule("SKD009", "HIGH", "total of a field that is in no data set", "foreign_totals > 0"),
    Rule("SKD010", "HIGH", "calculated field without an expression", "blank_calculated > 0"),
    Rule("SKD012", "MEDIUM", "all fields selected by the query", "stars > 0"),
]


def check_schemas(fields: DataFrame) -> DataFrame:
    """path and the rules a report schema breaks; ``fields`` come from the scan of report schemas."""
    part = lambda name: F.col("part") == name
    known = fields.where(~part("total")).select("path", "name").distinct().withColumn("there", F.lit(True))
    per = fields.join(known, ["path", "name"], "left").groupBy("path").agg(
        F.count_distinct("dataset").alias("sets"), F.count(F.when(part("dataset"), 1)).alias("fields"), F.count(F.when(part("dataset") & (F.coalesce("title", F.lit("")) == ""), 1)).alias("untitled"),
        F.count(F.when(part("total"), 1)).alias("totals"), F.count(F.when(part("total") & F.col("there").isNull(), 1)).alias("foreign_totals"),
        F.count(F.when(part("calculated") & (F.coalesce("expression", F.lit("")) == ""), 1)).alias("blank_calculated"), F.count(F.when(part("dataset") & F.col("expression").rlike(r"(?iu)(выбрать|select)\s+\*"), 1)).alias("stars"),
    )
    return per.select("path", F.inline(_violations(SCHEMA_RULES)))


def check_context_availability(calls: DataFrame, methods: DataFrame, directives: DataFrame) -> DataFrame:
    """rec_id, line, rule_id, method of platform methods called where they are not offered (CTX001) or deprecated (CTX002).

    ``calls`` and ``directives`` (the methods of the code) come from the readers of source code, ``methods`` is the
    platform's catalogue: availability names contexts, and an empty one says nothing.
    """
    side = directives.select("rec_id", F.lower("method").alias("__m"), F.when(F.lower("directive").startswith("наклиенте"), "тонкий клиент").otherwise("сервер").alias("place")).distinct()
    known = methods.where("name_ru IS NOT NULL").groupBy(F.lower(F.trim("name_ru")).alias("__c")).agg(F.max(F.lower(F.coalesce("availability", F.lit("")))).alias("offered"), F.max(F.trim(F.coalesce("version_deprecated", F.lit("")))).alias("gone"))
    met = calls.withColumn("__c", F.lower("callee_method")).join(known, "__c").withColumn("__m", F.lower("caller_method")).join(side, ["rec_id", "__m"])
    broken = F.array(F.when((F.col("offered") != "") & ~F.col("offered").contains(F.col("place")), F.lit("CTX001")), F.when(F.col("gone") != "", F.lit("CTX002")))
    return met.select("rec_id", "line", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule_id"), F.col("callee_method").alias("method"))
