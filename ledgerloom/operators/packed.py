"""Several values packed in one field: one row per value, with its position and an error flag.

Grammar (PEG, ordered alternatives)::

    list      <- (gap value)*
    gap       <- (space / delimiter / connector / opening bracket)*
    value     <- quoted &end / bare
    quoted    <- '"' ('""' / '\\' any / !'"' any)* '"' / the same for ' “ « „ `
    bare      <- (parenthesised / bracketed / !(delimiter / connector / closing bracket at an end) any)+
    parenthesised <- '(' (parenthesised / !')' any)* ')'
    bracketed     <- '[' (bracketed / !']' any)* ']'
    end       <- space* (delimiter / connector / closing bracket / end of text)

Brackets around a list or around single values belong to the gaps; brackets that follow the text of a value hold a part of
it and are not split.  A quote that is never closed, or whose closing quote is followed by text, makes ``quoted`` fail; the
parser goes back to the value's start and takes it as ``bare``, and the row carries ``error = 'malformed_quote'``.  A
parenthesis or bracket that is never closed is an ordinary character (``error = 'unbalanced_parenthesis'``).

The grammar compiles to one Java regular expression, which has no recursion: it is unrolled to ``LEVELS`` levels, and that
is exact for every text with no more opening marks than that.  Texts with more of them go through ``parse`` below, the same
grammar in Python with the partners of all marks found beforehand, in one pass, to any depth.

Nulls, blank texts and texts of delimiters only give no row.  Positions count from 1 over non-empty values.  Very long
texts are parsed whole in one pass.  Repeated input rows give repeated output rows unless the caller makes them distinct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.peg import ahead, choice, opt, plus, seq, star, without

SPACE = r"[\s\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]"
DELIMITER = r"[,;|/+\n\t]"
CONNECTOR = rf"{SPACE}(?:и|или|and|or|&){SPACE}"
# fixed values: opening and closing marks of quoted values
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("«", "»"), ("„", "“"), ("`", "`"))


def _quoted() -> str:
    def one(a: str, b: str) -> str:
        body = [rf"[^{b}\\]", r"\\."]
        if a == b:
            body.insert(0, b + b)
        return seq(a, star(choice(*body)), b)

    return choice(*(one(a, b) for a, b in QUOTES))


END = ahead(seq(star(SPACE), choice(DELIMITER, rf"(?:и|или|and|or){SPACE}", r"\]", r"\z")))
LEVELS = 6


def _nested(opening: str, closing: str, levels: int = LEVELS) -> str:
    """A group of balanced marks, unrolled."""
    plain = rf"[^{opening}{closing}]"
    body = star(plain)
    for _ in range(levels - 1):
        body = star(choice(plain + "++", rf"{opening}{body}{closing}"))
    return rf"{opening}{body}{closing}"


PARENTHESISED, BRACKETED = _nested(r"\(", r"\)"), _nested(r"\[", r"\]")
STOP = choice(DELIMITER, CONNECTOR, seq(r"\]", star(SPACE), choice(DELIMITER, r"\z")))
GAP = star(choice(rf"{SPACE}(?:и|или|and|or){SPACE}", SPACE, DELIMITER, r"\[", r"\](?=\s*(?:[,;|/+]|\z))"))
PLAIN = r"[^,;|/+\s()\[\]\u00a0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]++"
BARE = plus(choice(PLAIN, PARENTHESISED, BRACKETED, seq(without(STOP), r"(?s:.)")))
PATTERN = seq(r"\G", GAP, "(", choice(seq(_quoted(), END), BARE), ")")


OPENING = "".join(a for a, _ in QUOTES)
#: what a value must hold for any cleaning beyond the letter case
SPECIAL = rf"^[{OPENING}]|{SPACE}{{2}}|[^\S ]|^{SPACE}|{SPACE}$"


def _clean(raw: Column) -> Column:
    """Quotes off, escapes undone, white space collapsed, lower case."""
    body = F.substring(raw, F.lit(2), F.length(raw) - 2)
    undone = F.regexp_replace(F.regexp_replace(body, r'\\(["\'`“”«»\\])', "$1"), r"(\"|'|`)\1", "$1")
    text = F.when(_well_quoted(raw), undone).otherwise(raw)
    return F.when(raw.rlike(SPECIAL), F.trim(F.regexp_replace(text, SPACE + "+", " "))).otherwise(raw)


def _well_quoted(raw: Column) -> Column:
    return raw.rlike(r"(?s)\A" + _quoted() + r"\z")


def _error(raw: Column) -> Column:
    unclosed = F.regexp_count(raw, F.lit(r"\(")) != F.regexp_count(raw, F.lit(r"\)"))
    return F.when(raw.rlike(rf"\A[{OPENING}]") & ~_well_quoted(raw), F.lit("malformed_quote")).when(unclosed, F.lit("unbalanced_parenthesis"))


_SPACE, _GAP = re.compile(SPACE), re.compile(rf"(?:{SPACE}(?:и|или|and|or){SPACE}|{SPACE}|{DELIMITER}|\[|\](?=\s*(?:[,;|/+]|\Z)))*+")
_STOP = re.compile(rf"{DELIMITER}|{CONNECTOR}|\]{SPACE}*+(?:{DELIMITER}|\Z)")
_END = re.compile(rf"{SPACE}*+(?:{DELIMITER}|(?:и|или|and|or){SPACE}|\]|\Z)")
_RUN = re.compile(rf"(?:(?!{SPACE})[^,;|/+()\[\]])+")
_ESCAPE = re.compile(r"\\([\"'`“”«»\\])")


def _partners(text: str, opening: str, closing: str) -> dict[int, int]:
    """Place of the closing mark of every opening mark that has one."""
    held, pairs = [], {}
    for m in re.finditer(f"[{opening}{closing}]", text):
        if m[0] == opening[-1]:
            held.append(m.start())
        elif held:
            pairs[held.pop()] = m.start()
    return pairs


def _quoted_end(text: str, at: int) -> int:
    """Place behind the quoted value that begins here, or -1."""
    close = dict(QUOTES).get(text[at])
    if close is None:
        return -1
    i = at + 1
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 2
        elif text[i] == close:
            if close == text[at] and text[i + 1 : i + 2] == close:
                i += 2
                continue
            return i + 1
        else:
            i += 1
    return -1


def parse(text: str | None) -> list[tuple[str, str | None]]:
    """(item, error) of every value of one text, to any depth of parentheses and brackets."""
    text = re.sub(rf"{SPACE}*\.{SPACE}*\Z", "", text or "").lower()
    partner = _partners(text, r"\(", r"\)") | _partners(text, r"\[", r"\]")
    out: list[tuple[str, str | None]] = []
    at = 0
    while (at := _GAP.match(text, at).end()) < len(text):
        stop = _quoted_end(text, at)
        if stop < 0 or not _END.match(text, stop):
            stop = at
            while stop < len(text):
                if (run := _RUN.match(text, stop)) is not None:
                    stop = run.end()
                elif stop in partner:
                    stop = partner[stop] + 1
                elif _STOP.match(text, stop):
                    break
                else:
                    stop += 1
        raw = text[at:stop]
        quoted = _quoted_end(raw, 0) == len(raw)
        body = re.sub(r"(\"|'|`)\1", r"\1", _ESCAPE.sub(r"\1", raw[1:-1])) if quoted else raw
        item = re.sub(rf"{SPACE}+", " ", body).strip()
        if item:
            error = "malformed_quote" if not quoted and raw[0] in OPENING else "unbalanced_parenthesis" if raw.count("(") != raw.count(")") else None
            out.append((item, error))
        at = max(stop, at + 1)
    return out


def packed_values(df: DataFrame, value: str, *keep: str) -> DataFrame:
    """One row per packed value of column ``value``: the columns ``keep`` with ``pos`` (int), ``item`` and ``error``."""
    names = {"pos", "item", "error"}
    if names & set(keep):
        raise ValueError(f"kept columns may not be called {sorted(names)}")
    given = df.where(F.col(value).isNotNull())
    deep = F.regexp_count(F.col(value), F.lit(r"[(\[]")) > LEVELS
    text = F.lower(F.regexp_replace(F.col(value), rf"{SPACE}*\.{SPACE}*\z", ""))
    raws = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1)), F.trim)
    parsed = F.transform(raws, lambda raw: F.struct(_clean(raw).alias("item"), _error(raw).alias("error")))
    full = F.filter(parsed, lambda x: x["item"] != "")
    flat = (
        given.where(~deep)
        .select(*keep, F.posexplode(full).alias("__at", "__value"))
        .select(*keep, (F.col("__at") + 1).cast("int").alias("pos"), F.col("__value.item").alias("item"), F.col("__value.error").alias("error"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*head, pos, *v) for *head, t in b.itertuples(index=False, name=None) for pos, v in enumerate(parse(t), 1)]
            yield pd.DataFrame(rows, columns=[*keep, "pos", "item", "error"])

    schema = T.StructType([*given.select(*keep).schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("error", T.StringType())])
    return flat.unionByName(given.where(deep).select(*keep, F.col(value).alias("__text")).mapInPandas(run, schema))
