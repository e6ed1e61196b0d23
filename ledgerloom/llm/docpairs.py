"""Functions and methods paired with their documentation.

Source files are read once: a definition line gives the method, the block of whole-line comments directly above it (only
compiler directives between) its documentation, and the lines up to the end keyword its code.  Catalogue rows pair the
syntax with the description and the descriptions of the parameters.  A pair is kept if the documentation has at least
``MIN_WORDS`` words of its own: words that are not the method's name or its parts, parameter names, type names, section
headings, markup, separators or commented-out code.

Documentation tags (``doc_tags``): the sections of a comment block, description, parameters, returned value, example and
references, whether they are headed in words (``Параметры:``, ``Returns:``) or by marks (``@param``, ``@return``, ``@see``).

Inherited documentation: a method of an extension that is hung on a method of the extended module (``&Вместо("Name")`` and
its kin) has that method above it in the hierarchy, and a comment that says "see Module.Method" (``См.``, ``@see``) or
``{@inheritDoc}`` names one.  ``resolve_inherited`` hands documentation down such links step by step until no method
without one is reached any more; those that never are reached are dropped, cycles among them too.

Null and empty sources give no pair; a definition without an end keyword reaches to the next definition or the file's end;
the same name defined twice gives two pairs, told apart by the line.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed

MIN_WORDS = 4
DEFINITION = re.compile(r"^[\s﻿]*(?:(?:асинх|async)\s+)?(процедура|функция|procedure|function)\s+(\w+)\s*\(", re.I)
END = re.compile(r"^\s*(?:конецпроцедуры|конецфункции|endprocedure|endfunction)\b", re.I)
COMMENT = re.compile(r"^[\s﻿]*//")
DIRECTIVE = re.compile(r"^[\s﻿]*&\s*\w")
LINES = re.compile(r"\r\n|\n|\r")
SEE = re.compile(r"(?:\bсм\.|\bsee|\{@inheritdoc)\s+(?:также\s+|also\s+)?([\w.]*\w\.\w+)", re.I)
#: an extension's method is hung on one of the extended module
EXTENDS = re.compile(r"^[\s\ufeff]*&\s*(?:перед|после|вместо|изменениеиконтроль|before|after|around|instead|changeandvalidate)\s*\(\s*\"(\w+)\"\s*\)", re.I)
SECTION = re.compile(r"^\s*(?:@(?P<mark>\w+)|(?P<head>параметры|возвращаемое\s+значение|возвращает|пример(?:ы)?|см\.?\s+также|описание|parameters?|returns?|return\s+value|examples?|see\s+also|description)\s*:)\s*(?P<rest>.*)$", re.I)
# fixed values: what a section's heading or mark stands for
SECTIONS = {"параметры": "params", "parameter": "params", "parameters": "params", "param": "params", "возвращаемое значение": "returns", "возвращает": "returns", "return": "returns", "returns": "returns", "return value": "returns", "пример": "example", "примеры": "example", "example": "example", "examples": "example", "см. также": "see", "см также": "see", "see also": "see", "see": "see", "описание": "description", "description": "description", "deprecated": "deprecated"}
WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
CAMEL = re.compile(r"[A-ZА-ЯЁ]+(?![a-zа-яё])|[A-ZА-ЯЁ]?[a-zа-яё]+|\d+")
# fixed values: headings of documentation sections, and words that say that there is no documentation
HEADINGS = re.compile(
    r"^\W*(?:параметры|возвращаемое\s+значение|возвращает|описание|примечани[ея]|пример(?:ы)?|варианты\s+вызова|устарела|parameters?|returns?|return\s+value|description|"
    r"notes?|examples?|remarks|see\s+also|см\.?\s+также|тип|type)\s*:",
    re.I,
)
EMPTY = re.compile(r"^\W*(?:todo|tbd|fixme|n/a|xxx|hack)\b", re.I)
# fixed values: type names of the platform, Russian and English
TYPES = frozenset(
    "строка число булево дата структура массив соответствие произвольный таблицазначений деревозначений списокзначений неопределено тип описаниетипов запрос выборка "
    "двоичныеданные уникальныйидентификатор фиксированнаяструктура фиксированныймассив хранилищезначения стандартныйпериод любой "
    "string number boolean date structure array map arbitrary valuetable valuetree valuelist undefined type query binarydata uuid any".split()
)
TYPE_NAME = re.compile(r"\b(?:справочник|документ|перечисление|регистр\w+|планвидов\w+|catalog|document|enum|\w+register)(?:ссылка|объект|ref|object|менеджер|manager)?\.\w+", re.I)
# a line of code that was commented out
CODE = re.compile(
    r";\s*$|^\s*(?:если|иначеесли|elsif|if)\b.*\b(?:тогда|then)\s*$|^\s*(?:для|пока|for|while)\b.*\b(?:цикл|do)\s*$"
    r"|^\s*(?:попытка|исключение|иначе|try|except|else|возврат|return|конец\w+|end(?:if|do|try|procedure|function))\s*$"
    r"|^\s*(?:процедура|функция|procedure|function)\s+\w+\s*\(.*$|^\s*[\w.\[\]\"]+\s*=\s*\S|^\s*[\w.]+\([^)]*\)\s*[;.]?\s*$|^\s*#\s*(?:область|region|если|if|конец\w+|end\w+)\b|^\s*&\w+\s*$|^\s*\|",
    re.I,
)
PARAMETER = re.compile(r"^\s*\*?\s*(\w+)\s*[-–—:]\s*(.*)$")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>|<[^<>]*>")


@functools.lru_cache(maxsize=200_000)
def name_words(name: str) -> frozenset[str]:
    return frozenset(w.lower() for w in [name, *CAMEL.findall(name)])


def own_words(lines: tuple[str, ...], names: tuple[str, ...], parameters: tuple[str, ...]) -> int:
    """Number of words of a documentation that say something of their own."""
    skip = set().union(*(name_words(n) for n in names if n), (p.lower() for p in parameters if p))
    n = 0
    for line in lines:
        if not line or CODE.search(line):
            continue
        text = html.unescape(html.unescape(line)) if "&" in line else line
        if "<" in text:
            text = TAG.sub(" ", text)
        if EMPTY.match(text):
            continue
        text = HEADINGS.sub(" ", text)
        text = TYPE_NAME.sub(" ", text)
        n += sum(1 for w in WORD.findall(text) if (k := w.lower()) not in skip and k not in TYPES)
    return n


def header_of(lines: list[str], at: int, stop: int) -> str:
    """The signature that begins on a line, to its closing parenthesis, without comments."""
    first = lines[at]
    if first.count("(") == 1 and '"' not in first and "//" not in first and (end := first.find(")")) >= 0:
        return first[: end + 1]
    out, depth, quoted = [], 0, False
    for line in lines[at : stop + 1]:
        i = 0
        while i < len(line):
            c = line[i]
            if c == '"':
                quoted = not quoted
            elif not quoted and line.startswith("//", i):
                break
            elif not quoted and c in "()":
                depth += 1 if c == "(" else -1
                if c == ")" and depth == 0:
                    return " ".join([*out, line[: i + 1]])
            i += 1
        out.append(line[:i])
    return " ".join(out)


def parameter_names(header: str) -> tuple[str, ...]:
    inside = re.sub(r'"(?:[^"]|"")*"', "", header.partition("(")[2].rpartition(")")[0] or header.partition("(")[2])
    return tuple(m[0] for p in inside.split(",") if (m := re.findall(r"\w+", re.sub(r"^\s*(?:знач|val)\b", "", p.split("=")[0], flags=re.I))))


def doc_tags(block: Iterable[str]) -> dict[str, str | dict[str, str]]:
    """description, params (name -> text), returns, example, see, deprecated of a comment block; only those it has."""
    parts: dict[str, list[str]] = {}
    params: dict[str, list[str]] = {}
    section, name = "description", None
    for line in block:
        m = SECTION.match(line)
        if m:
            word = re.sub(r"\s+", " ", (m["mark"] or m["head"]).lower())
            section, name, line = SECTIONS.get(word, word), None, m["rest"]
            if section == "params" and m["mark"] and (first := re.match(r"\s*(\w+)\s*[-–—:]?\s*(.*)$", line)):
                name = first[1]
                params[name] = [first[2]]
                continue
        if section == "params":
            if (first := PARAMETER.match(line)) and not line.startswith((" " * 6, "\t\t")):
                name = first[1]
                params[name] = [first[2]]
            elif name and line.strip():
                params[name].append(line.strip())
        elif line.strip():
            parts.setdefault(section, []).append(line.strip())
    out: dict = {k: " ".join(v) for k, v in parts.items()}
    return out | ({"params": {k: " ".join(x for x in v if x) for k, v in params.items()}} if params else {})


def functions_of(code: str | None, tags: bool = True) -> Iterator[dict]:
    """Every procedure and function of a source text with its documentation block and code (and its tags, if wanted)."""
    if not code:
        return
    lines = LINES.split(code)
    marks = [(i, m) for i, line in enumerate(lines) if (m := DEFINITION.match(line))]
    for k, (i, m) in enumerate(marks):
        j = i - 1
        while j >= 0 and DIRECTIVE.match(lines[j]):
            j -= 1
        top = j
        while top >= 0 and COMMENT.match(lines[top]):
            top -= 1
        block = tuple(re.sub(r"^[\s﻿]*/{2,}", "", line).strip() for line in lines[top + 1 : j + 1])
        limit = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        stop = next((x for x in range(i, limit) if END.match(lines[x])), limit - 1)
        header = header_of(lines, i, stop)
        hung = next((x[1] for line in lines[j + 1 : i] if (x := EXTENDS.match(line))), None)
        see = SEE.search(" ".join(block))
        yield {
            "method_name": m[2], "line_no": i + 1, "doc": "\n".join(block).strip(), "code": "\n".join(lines[i : stop + 1]),
            "words": own_words(block, (m[2],), parameter_names(header)), "overrides": see[1] if see else None,
            "extends": hung, "tags": json.dumps(doc_tags(block), ensure_ascii=False) if block and tags else None,
        }


def parameter_docs(text: str | None) -> list[tuple[str, str]]:
    """(name, description) of a parameter list in JSON; of a damaged list, what can still be read."""
    if not text or not text.strip():
        return []
    value = text
    for _ in range(3):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value)
        except ValueError:
            names = re.findall(r'"name"\s*:\s*"((?:[^"\\]|\\.)*)', value)
            docs = re.findall(r'"description"\s*:\s*"((?:[^"\\]|\\.)*)', value)
            return [(n, "") for n in names] + [("", d) for d in docs]
    items = value if isinstance(value, list) else [value]
    return [(str(x.get("name") or ""), str(x.get("description") or "")) for x in items if isinstance(x, dict)]


def _catalogue_words(description: str, params: str, name_ru: str, name_en: str) -> int:
    listed = parameter_docs(params)
    lines = [x for x in re.split(r"[\r\n]+|<br\s*/?>", description)] + [d for _, d in listed]
    return own_words(tuple(lines), (name_ru, name_en), tuple(n for n, _ in listed))


_remembered = functools.lru_cache(maxsize=20_000)(_catalogue_words)


def catalogue_words(description: str, params: str, name_ru: str, name_en: str) -> int:
    """Number of words of its own of a catalogue row; short texts, which repeat, are remembered."""
    return (_remembered if len(description) + len(params) <= 1000 else _catalogue_words)(description, params, name_ru, name_en)


SOURCE_PAIRS = "rec_id bigint, method_name string, line_no int, doc string, code string, words int, overrides string, extends string, tags string"


def source_pairs(df: DataFrame, key: str, code: str, tags: bool = False) -> DataFrame:
    """rec_id, method_name, line_no, doc, code, words, overrides (a method the comment refers to), extends (one it is hung
    on), tags (JSON of ``doc_tags``, null unless asked for) of every definition, documented or not."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SOURCE_PAIRS.split(", ")]
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                yield pd.DataFrame([(k, *(f[c] for c in columns[1:])) for k, text in zip(part[key], part[code]) for f in functions_of(text, tags)], columns=columns)

    return df.select(F.col(key).cast("bigint").alias(key), code).mapInPandas(run, SOURCE_PAIRS)


def catalogue_pairs(df: DataFrame, key: str = "id") -> DataFrame:
    """rec_id, method_name, doc, code, words of catalogue rows whose syntax has a parameter list in parentheses."""

    @F.pandas_udf("int")
    def words(description, params, name_ru, name_en):
        text = [x.fillna("") for x in (description, params, name_ru, name_en)]
        return pd.Series([catalogue_words(*row) for row in zip(*text)], dtype="int32")

    @F.pandas_udf("string")
    def documentation(description, params):
        return pd.Series(
            ["\n".join([d, *(f"{n} - {x}" for n, x in parameter_docs(p) if x)]).strip() for d, p in zip(description.fillna(""), params.fillna(""))], dtype="object"
        )

    return df.where(F.col("syntax").rlike(r"\([^)]*\)")).select(
        F.col(key).alias("rec_id"), F.col("name_ru").alias("method_name"), documentation("description", "params_json").alias("doc"), F.trim("syntax").alias("code"),
        words("description", "params_json", "name_ru", "name_en").alias("words"),
    )


def resolve_inherited(methods: DataFrame) -> DataFrame:
    """node, doc, depth: the nearest documentation up the chain of overridden methods.

    ``methods``: node (unique), parent (the overridden node, may be null), doc (null if undocumented).  Each round hands
    the documented node's name down to the undocumented methods directly below those reached last; it ends when none is
    reached.  The texts themselves move once, at the end.
    """
    own = methods.where("doc IS NOT NULL").select("node", F.col("node").alias("origin"), F.lit(0).alias("depth"))
    links = checkpointed(methods.where("doc IS NULL AND parent IS NOT NULL AND parent <> node").select("node", "parent"))
    frontier, depth = checkpointed(own), 0
    done, pieces = frontier, 1
    while True:
        depth += 1
        frontier = checkpointed(links.join(frontier.select(F.col("node").alias("parent"), "origin"), "parent").select("node", "origin", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        done, pieces = done.unionByName(frontier), pieces + 1
        if pieces == 20:  # keeps the plan short on deep hierarchies
            done, pieces = checkpointed(done), 1
    return done.join(methods.where("doc IS NOT NULL").select(F.col("node").alias("origin"), "doc"), "origin").select("node", "doc", "depth")


def one_per_node(df: DataFrame) -> DataFrame:
    """Of methods delivered more than once under one node, the documented and latest."""
    w = Window.partitionBy("node").orderBy(F.col("doc").isNull(), F.col("rec_id").desc(), F.col("line_no").desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
