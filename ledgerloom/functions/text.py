"""Words of identifiers and texts."""

from __future__ import annotations

import functools

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: endings cut off by the stemmer, in the order in which they are tried
RU_ENDINGS = (
    "ыми ях ах ого ому ему ом ой ое ую юю ая яя ые ие ых их ими ам ям ами ями ем ть тся ться лся лась ешь ишь ете ите ут ют ат ят ал ял ала яла али яли "
    "анный енный ный ная ное ные ного ной ным ном нами ность ние ния ний нем а я о е у ю и ы ь"
).split()
EN_ENDINGS = "ization ational fulness ousness iveness tional ation ement ness ions ing ied ies ier iest ed es ly ment tion sion ence ance able ible al er est s".split()

_RUN = regex.compile(r"\p{L}+")
_BORDER = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
WORDS = r"[а-яёa-z0-9]+"


def identifier_words(name: str) -> list[str]:
    """Words of a CamelCase identifier; acronyms stay whole, single letters are dropped."""
    return [w for run in _RUN.findall(name or "") for w in _BORDER.split(run) if len(w) >= 2]


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The word without its ending; at least three letters stay."""
    if len(word) < 4:
        return word
    endings = RU_ENDINGS if "а" <= word[0] <= "я" or word[0] == "ё" else EN_ENDINGS
    return next((word[: -len(e)] for e in endings if len(word) > len(e) + 2 and word.endswith(e)), word)


def stems(text: str | None, synonyms: dict[str, str] | None = None) -> list[str]:
    """Stemmed words of a text; with a Russian-English table each word brings its counterpart along."""
    out = [s for w in identifier_words(text or "") if len(s := stem(w.lower())) >= 2]
    if synonyms:
        back: dict[str, str] = {}
        for ru, en in synonyms.items():
            back.setdefault(en, ru)
        for w in list(out):
            other = synonyms.get(w) or back.get(w)
            if other and other not in out:
                out.append(other)
    return out


def stems_column(text: Column, synonyms: dict[str, str] | None = None) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: stems(t, synonyms))

    return run(text)


def words_column(text: Column) -> Column:
    """Lower-case words, on the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def trigrams_column(word: Column) -> Column:
    """Distinct trigrams of a word padded with two marks on either side."""
    padded = F.concat(F.lit("$$"), word, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def version_parts(v: Column) -> Column:
    """A dotted version as numbers that compare part by part."""
    return F.transform(F.split(v, r"\."), lambda p: p.cast("int"))
