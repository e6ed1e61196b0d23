"""Prose sentences of a document that also holds code, query text, headings and identifiers.

``sentences(text)`` yields (start, end, sentence): offsets in code points of the stored text, and the sentence with
markup undone, white space and Unicode forms normalised.  Comments, quotes, list items and question/answer marks are
opened up first, so prose in comments counts; fenced blocks are read line by line like any other text.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

# marks that may stand before prose: comment, quote, list item, question/answer
PREFIX = re.compile(r"^(?:\s|﻿|//+|\|(?=\s*//)|>+|[-*•–—+](?=\s)|\d{1,3}[.)](?=\s)|[QAВО]:(?=\s)|/\*|\*/|<!--|#(?=!))+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<\|[^|<>]*\|>")
END = re.compile(r"[.!?…]+[\"'»”)\]]*(?=\s|$|<|&)")
OPENS = re.compile(r"^[\"'«“„(¿¡\[]*[^\W\d_]")
WORDS = re.compile(r"[^\W\d_]+(?:['’ʼ`-][^\W\d_]+)*")
# marks that prose doesn't hold: assignment, braces, row marks, paths, chained calls, a semicolon at the end; what stands
# before each is a cheap test, for most sentences hold none of them
SURE = (("=", None), ("{", None), ("}", None), ("|", None), ("</", None), ("::", None), (").", re.compile(r"\)\.\w")), (".", re.compile(r"[^\W\d]\.\w+\.\w")), (";", re.compile(r";\W*$")))
CALL = re.compile(r"\w+\((?!\w{1,3}\))[^()]*\)?")  # not the ending in "file(s)"
# marks that prose may hold too: code only where two kinds of them meet
KEYWORD = re.compile(r"\b(?:Конец(?:Функции|Процедуры|Если|Цикла|Попытки)|ИначеЕсли|ВызватьИсключение|End(?:Function|Procedure|If|Do|Try)|ElsIf)\b", re.IGNORECASE)
INDEX = re.compile(r"\w\[")
HEADING = re.compile(r"^\s*#{1,6}\s")
# invisible format characters (category Cf)
FORMAT = re.compile("[" + "".join(re.escape(chr(i)) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cf") + "]+")
LINE = re.compile(r"[^\r\n  \x0b\x0c\x85]+")


def clean(text: str) -> str:
    """Markup undone, compatibility forms and white space normalised."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = TAG.sub(" ", text)
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = " ".join(text.split())
    return text if text.isprintable() else " ".join(FORMAT.sub("", text).split())  # format characters are not printable


def is_code(s: str) -> bool:
    """A sure mark of code, two kinds of marks that prose shares, or fewer than three words beside the calls."""
    if s.lstrip()[:1] in ("&", "#", "<") or any(mark in s and (rule is None or rule.search(s)) for mark, rule in SURE):
        return True
    shared = (";" in s) + ("(" in s and bool(CALL.search(s))) + ("[" in s and bool(INDEX.search(s)))
    if shared and (shared > 1 or KEYWORD.search(s)):
        return True
    return "(" in s and len(WORDS.findall(CALL.sub(" ", s))) < 3


def is_sentence(s: str) -> bool:
    """A whole sentence: opens with a letter, ends with a stop, holds at least three words and no code."""
    return bool(OPENS.match(s)) and s.rstrip("\"'»”)]").endswith((".", "!", "?", "…")) and len(WORDS.findall(s)) >= 3 and not is_code(s)


def _in_line(raw: str) -> list[tuple[int, int, str]]:
    if HEADING.match(raw):
        return []
    found = []
    at = raw.rfind("//") if "//" in raw and not raw.lstrip("\ufeff \t\xa0|>").startswith("//") and "://" not in raw else -1
    for offset, part in [(0, raw)] if at < 0 else [(0, raw[:at]), (at, raw[at:])]:
        opened = PREFIX.match(part)
        pos = opened.end() if opened else 0
        for stop in [*(x.end() for x in END.finditer(part, pos)), len(part)]:
            if stop > pos:
                s = clean(part[pos:stop])
                if s and not (s[0].isalpha() and s[1:2] != ":"):
                    s = PREFIX.sub("", s)
                if s and is_sentence(s):
                    found.append((offset + pos, offset + stop, s))
            pos = stop
    return found


_seen: dict[str, list[tuple[int, int, str]]] = {}


def sentences(text: str | None) -> Iterator[tuple[int, int, str]]:
    if not text:
        return
    for m in LINE.finditer(text):
        raw = m[0]
        found = _seen.get(raw)
        if found is None:
            found = _in_line(raw)
            if len(raw) <= 500:  # repeated lines are read once; the table is bounded
                if len(_seen) >= 50_000:
                    _seen.clear()
                _seen[raw] = found
        for a, b, s in found:
            yield m.start() + a, m.start() + b, s
