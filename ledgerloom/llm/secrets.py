"""Credentials embedded in source code: found with their place, and redacted.

Candidates come first: the quoted strings of a line, its long tokens, quoted or not, and the values that stand behind a
name in connection strings, addresses, XML, JSON, configuration lines and comments.  Each candidate shows how random it is:
the Shannon entropy of its characters over the most that its own alphabet (digits, hexadecimal, letters of one or more
kinds, signs) and its length allow.  It is flagged above a threshold that falls with its length and depends on what its
surroundings say: least where a name says password, more where one says token or key, most where nothing does.  Then
hashes, identifiers, images, certificates and public keys, masks, template marks and known placeholders are left out, by
their own form and by the names they stand behind.

Lines are judged one by one (a line end is CR LF, LF or CR).  A key in PEM form is a header line, lines of base64 of any
number and an END line; it begins at its header line and reaches to its END line for redaction.  A header with no base64
after it is text like any other, and nothing else on its line is skipped.  Null and empty sources give nothing; the same
secret twice on one line is one row.
"""

from __future__ import annotations

import base64
import binascii
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|$)")
PASS, TOKEN, ANY = "password", "token", "secret"
# fixed values: words that name a password or a token, and words that name something else that looks random
PASS_WORDS = r"парол[а-яё]*|password|passwd|passphrase|pwd|pass|секрет[а-яё]*|secret|пар"
TOKEN_WORDS = r"токен[а-яё]*|token|api[_\- ]?key|apikey|access[_\- ]?key|secret[_\- ]?key|private[_\- ]?key|auth[_\- ]?key|account[_\- ]?key|client[_\- ]?secret|bearer|credential[s]?"
TOKEN_NAME = re.compile(r"(?:токен|token|api[_\- ]?key|ключ[_ ]?(?:api|апи|доступа|подписи|сервиса|шифрования|авторизации)|(?:access|secret|private|auth|account|signing|encryption)[_\- ]?key|credential|authorization|x-auth)", re.I)
PASS_NAME = re.compile(r"(?:парол|password|passwd|passphrase|pwd|секрет|secret)|(?<![^\W_])(?:pass|пар)(?![^\W_])", re.I)
NOT_NAME = re.compile(r"отпечат|fingerprint|thumbprint|хеш|хэш|hash|картинк|image|picture|сертификат|certificate|public|открыт|идентификатор|uuid|guid|commit|checksum|контрольн|подсказк|заголовок(?!и)|имяпарам|длина|length|срок|expire|url|адрес|путь|path|field|поле", re.I)
PLACEHOLDER = re.compile(
    r"^(?:[*xх•.#?_\-]+|%\w*%?|%\(?\w+\)?s?|<[^<>]*>|\{+[^{}]*\}+|\$\{?[\w.]+\}?|\[[^\[\]]*\]|&\w+|@+\w+@*|#\w+#|_+\w+_+|"
    r"(?:my|your|мой|ваш)[_\-\s]?\w*|(?:change[_\-]?me|example|sample|demo|test|тест|пример|none|null|nil|undefined|неопределено|empty|пусто|default|todo|tbd|n/a|"
    r"введите.*|укажите.*|enter.*|insert.*|secret|password|passwd|pwd|pass|token|пароль|секрет|токен|ключ|key|apikey|api_key|login|логин|user|bearer|basic))$",
    re.I,
)
UUID = re.compile(r"^\{?[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}?$", re.I)
MAGIC = ("iVBOR", "/9j/", "R0lGOD", "JVBER", "UEsDB", "PHN2Z", "MIIC", "MIID", "MIIE", "AAAAB3", "data:")
CONTINUED = re.compile(r'(?:\s*\+\s*"[^"\r\n]*")+')
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
SCHEME = re.compile(r"^(?:bearer|basic|token|digest|apikey|api-key)\s+", re.I)
ENTRY_WORDS = r"вход|логин|login|log[ -]?in|sign[ -]?in|уч[её]тн\w+|credentials?"
CALL_WORDS = r"авториз|authori[sz]e|authenticate|logon|войти|подключить|connect|соединение|прокси|proxy|профиль"
# a fast look for lines worth judging: what the words of the rules below begin with, a key header, a user in an address, any
# long token; of the many lines that mention a key only those with a digit behind it, for no key is a word
TRIGGER = re.compile(
    rf"парол|секрет|токен|(?<!\w)пар(?!\w)|ключ(?=[^\r\n]*\d)|вход|логин|уч[её]тн|авториз|войти|подключить|соединение|прокси|профиль|"
    r"pass|pwd|secret|token|key(?=[^\r\n]*\d)|bearer|credential|basic |auth|log[ -]?in|logon|sign[ -]?in|connect|proxy|-----begin|://[^\s\"/]+:[^\s\"/]+@|(?<![a-z0-9+/=])[a-z0-9][a-z0-9+/=_.\-]{19}"
)

VALUE = r'((?:[^"\r\n]|"")*)'
ASSIGNED = re.compile(rf'((?<![\w.\-])[\w.\-]++|\["[\w.\-]+"\])\s*[=:]\s*"{VALUE}("?)')
INSERTED = re.compile(rf'\(\s*"([\w.\-]+)"\s*,\s*"{VALUE}"')
CONNECTION = re.compile(rf'(?:(?:http|ftp|ws|com|https)?(?:соединение|connection)|прокси|proxy|профиль)\s*\(\s*"[^"]*"\s*,\s*[^,"()]*,\s*"[^"]*"\s*,\s*"{VALUE}"', re.I)
LOGIN = re.compile(rf'(?:авториз\w*|authori[sz]e|authenticate|login|logon|войти|подключить\w*|connect)\s*\(\s*"[^"]*"\s*,\s*"{VALUE}"', re.I)
PAIR = re.compile(rf'(?<![^\s;&?|"\'{{,])(?P<name>[\w.\-]*?(?:{PASS_WORDS}|{TOKEN_WORDS}|ключ_?\w*|_key)[\w\-]*)=(?P<value>""|[^;&"\s<>]+)', re.I)
QUOTED_PAIR = re.compile(r'(?<![^\s;"])(?P<name>[\w.\-]*+)=""(?P<value>[^"\r\n]*)""', re.I)
JSON_PAIR = re.compile(r'(?P<q>""|"|\')(?P<name>[\w.\-]+)(?P=q)\s*:\s*(?P=q)(?P<value>[^"\'\r\n]*)(?P=q)')
XML_PAIR = re.compile(r"<(?P<name>(?:\w+:)?[\w.\-]+)(?:\s[^<>]*)?>(?P<value>[^<>\r\n]*)</(?P=name)>")
URL = re.compile(r"(?<![a-z0-9+.\-])[a-z][a-z0-9+.\-]*+://[^\s\"'/:@]+:(?P<value>[^\s\"'/@]+)@", re.I)
SCHEMED = re.compile(r'"(?:Bearer|Basic|Token)\s+([^"\s]+)"', re.I)
SAID = re.compile(
    r"(?<!\w)(?P<name>парол[а-яё]*|password|passwd|passphrase|pwd|pass|токен[а-яё]*|token|ключ[а-яё]*|key|секрет[а-яё]*|secret)(?P<link>(?:\s+(?:сервиса|доступа|пользователя|api|апи|базы|was|is|был[аи]?|для\s+\w+|от\s+\w+|of\s+\w+|for\s+\w+))*\s*(?:[:=–—\-](?=\s))?)\s*(?P<value>\S+)",
    re.I,
)
# user and password side by side in a comment that speaks of a login
ENTRY = re.compile(rf"(?<!\w)(?:{ENTRY_WORDS})(?!\w)[^/\r\n]*?\s(?P<user>[\w.@\-]+)\s+/\s+(?P<value>\S+)", re.I)
# a line of a configuration file: a name, a colon and one bare value
SETTING = re.compile(r"^\s*(?:-\s+)?(?P<name>[A-Za-z_][\w.\-]*)\s*:\s*(?P<value>[^\s\"'{\[&*!|>%@`#,][^\s\"',]*)\s*(?:#.*)?$")
QUOTED = re.compile(r'"([^"\s]{20,})"')
LONG = re.compile(r"(?<![A-Za-z0-9+/=_.\-])[A-Za-z0-9][A-Za-z0-9+/=_\-]{23,}(?![A-Za-z0-9+/=_.\-]|\s*\()")
PREFIXED = re.compile(r"^(?:gh[pousr]_|xox[abprs]-|AKIA|AIza|sk-|glpat-|eyJ[\w-]{8,}\.eyJ)")
KEY_LINE = re.compile(r"^[\s|\"+]*(?:[\w-]+: [^\"]*|[A-Za-z0-9+/=\s]*)[\s\"+;]*$")


def entropy(s: str) -> float:
    """Bits per character of the string's own distribution."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> int:
    """Size of the alphabet the string is drawn from."""
    if re.fullmatch(r"[0-9]+", s):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s):
        return 16
    size = 26 * bool(re.search("[a-z]", s)) + 26 * bool(re.search("[A-Z]", s)) + 10 * bool(re.search("[0-9]", s)) + 33 * bool(re.search("[а-яёА-ЯЁ]", s))
    return max(2, size + 12 * bool(re.search(r"[^\w]|_", s)))


def randomness(s: str) -> float:
    """Entropy over the most that the string's alphabet and length allow, 0 to 1."""
    most = math.log2(min(len(s), alphabet(s))) if len(s) > 1 else 1.0
    return entropy(s) / most


def threshold(n: int, kind: str) -> float:
    """The randomness from which on a string of ``n`` characters is flagged: short strings must show more of it."""
    if kind == PASS:
        return 0.3 + 1.2 / n
    if kind == TOKEN:
        return 0.55 + 0.8 / n
    return 0.8 - 0.002 * min(n, 50)


def harmless(value: str) -> bool:
    """Placeholders, masks, template marks, identifiers and plain words."""
    return bool(re.search(r"\s", value) or PLACEHOLDER.match(value) or UUID.match(value) or re.search(r"%\d|\{\d\}|<[^<>]*>", value) or re.fullmatch(r"[А-Яа-яЁё.,()]+", value))


def flagged(value: str, kind: str) -> bool:
    """Is the candidate a secret, given what its surroundings say?"""
    n = len(value)
    if n < (4 if kind == PASS else 8 if kind == TOKEN else 20) or randomness(value) <= threshold(n, kind) or harmless(value):
        return False
    if kind == PASS:
        return True
    if kind == TOKEN:  # a word or a number is none
        return n >= 20 or not re.fullmatch(r"[A-Za-zА-Яа-яЁё]+|\d{1,9}", value)
    # nothing says so: checksums are hexadecimal, identifiers are words, and files in base64 begin with their marks
    if PREFIXED.match(value):
        return True
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value))
    return kinds == 3 and not value.startswith(MAGIC) and not re.fullmatch(r"[0-9a-fA-F\-]+", value)


def scattered(value: str) -> bool:
    """Do digits and capitals change as often as in a random string?  Identifiers in camel case, paths and versions don't."""
    classes = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", value))
    changes = sum(x != y for x, y in zip(classes, classes[1:]))
    return changes / len(value) > 0.42 and len(re.findall(r"\d+", value)) >= 3


def kind_of(name: str) -> str | None:
    if NOT_NAME.search(name):
        return None
    if TOKEN_NAME.search(name):
        return TOKEN
    return PASS if PASS_NAME.search(name) else None


def basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value, validate=True)
    except (binascii.Error, ValueError):
        return False


def _comment_at(line: str) -> int:
    """Offset of the comment in a line, or -1."""
    quoted = False
    start = 1 if line.lstrip().startswith("|") else 0
    if start:
        quoted = True
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif c == "/" and not quoted and line.startswith("//", i):
            return i
    at = line.find("//")
    return at if quoted and line.lstrip("﻿ \t").startswith("//") else -1


def named_values(line: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, value, kind, rest) of the candidates that a name, a header, a user or a sentence stands before; ``rest`` is
    what a literal goes on with behind a plus, which is judged with it."""
    for m in ASSIGNED.finditer(line):
        if (kind := kind_of(m[1])) and m[3] and not re.search(r'""|[=:<>]""|://|;\w+=', m[2]):
            rest = CONTINUED.match(line, m.end())
            yield m.start(2), m[2], kind, "".join(re.findall(r'"([^"]*)"', rest[0])) if rest else ""
    for m in INSERTED.finditer(line):
        if kind := kind_of(m[1]):
            yield m.start(2), m[2], kind, ""
    for pattern in (CONNECTION, LOGIN):
        for m in pattern.finditer(line):
            yield m.start(1), m[1], PASS, ""
    for pattern in (PAIR, QUOTED_PAIR, JSON_PAIR, XML_PAIR, SETTING):
        for m in pattern.finditer(line):
            if (kind := kind_of(m["name"])) and m["value"] not in ("", '""'):
                if pattern is SETTING and kind == TOKEN and not re.search(r"\d", m["value"]):
                    continue  # a bare word is an identifier
                yield m.start("value"), m["value"], kind, ""
    for m in URL.finditer(line):
        yield m.start("value"), m["value"], PASS, ""
    for m in SCHEMED.finditer(line):
        if not m[0].lower().startswith('"basic') or basic(m[1]):
            yield m.start(1), m[1], TOKEN, ""
    at = _comment_at(line)
    if at < 0:
        return
    for pattern in (SAID, ENTRY):
        for m in pattern.finditer(line, at):
            value = m["value"].rstrip(".,;)") if not m["value"].endswith(("!", "?")) else m["value"]
            kind = PASS if pattern is ENTRY or PASS_NAME.search(m["name"]) else TOKEN
            told = pattern is ENTRY or m["link"].strip()[-1:] in (":", "=", "-", "–", "—")
            if value.startswith('"') or "(" in value or value.endswith(('"', '";')):
                continue  # commented-out code: judged above
            # in running text a secret must differ from a word: digits, signs or capitals inside, or a foreign script
            foreign = bool(re.search("[а-яё]", m[0][: m.start("value") - m.start()], re.I)) if pattern is ENTRY else bool(re.search("[а-яё]", m["name"], re.I))
            odd = bool(re.search(r"\d|[^\w.,!?…]|_|[a-z][A-Z]", value)) or (told and pattern is not ENTRY or foreign) and bool(re.fullmatch(r"[a-z]{8,}", value))
            if odd and (kind == PASS or len(value) >= 16) and re.search(r"[A-Za-z0-9]", value):
                yield m.start("value"), value, kind, ""


def unnamed_values(line: str) -> Iterator[tuple[int, str]]:
    """(start, value) of quoted strings and long tokens that no name explains away as something else."""
    for pattern in (QUOTED, LONG):
        for m in pattern.finditer(line):
            value = m[1] if pattern is QUOTED else m[0]
            before = line[: m.start()].rstrip()
            name = re.search(r"([\w.]+)\W*$", before)
            if before.endswith("+") or name and NOT_NAME.search(name[1]) or "идентификатор" in before.lower():
                continue
            if pattern is LONG and (before.endswith('"') or not scattered(value) or "://" in before[-200:] or before.endswith(("|", "/"))):
                continue
            yield m.start(1) if pattern is QUOTED else m.start(), value


def _in_line(line: str) -> tuple[tuple[int, int, str], ...]:
    found: dict[tuple[int, int], str] = {}
    for start, value, kind, rest in named_values(line):
        m = SCHEME.match(value)
        if m:
            start, value, kind = start + m.end(), value[m.end() :], TOKEN
            if m[0].lower().startswith("basic") and not basic(value):
                continue
        if value and "-----BEGIN" not in value and flagged(value + rest, kind):
            found.setdefault((start, start + len(value)), kind)
    for start, value in unnamed_values(line):
        if flagged(value, ANY) and not any(a < start + len(value) and start < b for a, b in found):
            found[(start, start + len(value))] = ANY
    # of overlapping spans the first and longest one stays
    spans, end = [], -1
    for (a, b), kind in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1])):
        if a >= end:
            spans.append((a, b, kind))
            end = b
    return tuple(spans)


_remembered = functools.lru_cache(maxsize=20_000)(_in_line)


def in_line(line: str) -> tuple[tuple[int, int, str], ...]:
    """(start, end, kind) of the secrets of one line, without key blocks.  Short lines, which repeat, are remembered."""
    return _remembered(line) if len(line) <= 300 else _in_line(line)


def _key_end(text: str, at: int, block: str) -> tuple[int, int]:
    """Where the key whose header ends at ``at`` ends, and where its header's line does; -1 if no base64 follows."""
    close = f"-----END {block}-----"
    first = LINE.match(text, at)
    stop = text.find(close, at, first.end(1))
    if stop >= 0:
        return stop + len(close), stop + len(close)
    rest = first[1]
    if not KEY_LINE.match(rest):
        return -1, -1
    size, end, pos = len(re.sub(r"[^A-Za-z0-9+/=]", "", rest)), first.end(1), first.end()
    while pos < len(text):
        m = LINE.match(text, pos)
        stop = m[1].find(close)
        if stop >= 0 and KEY_LINE.match(m[1][:stop]):
            return m.start(1) + stop + len(close), first.end(1)
        if not m[1].strip() or not KEY_LINE.match(m[1]):
            break
        size, end, pos = size + len(m[1].strip()), m.end(1), m.end()
    return (end, first.end(1)) if size >= 16 else (-1, -1)  # never closed


def find_secrets(text: str | None) -> Iterator[tuple[int, int, int, int, str]]:
    """(line_no, start, end, redact_to, kind): offsets in the text; ``redact_to`` is where the secret's last part ends."""
    if not text or not TRIGGER.search(text.lower()):
        return
    skip_to = 0
    for number, m in enumerate(LINE.finditer(text), 1):
        line, offset = m[1], m.start(1)
        if m.end(1) > skip_to and line and TRIGGER.search(line.lower()):
            blocks = []
            at = max(offset, skip_to)
            while (key := PEM.search(text, at, m.end(1))) is not None:
                stop, header_end = _key_end(text, key.end(), key[1])
                at = key.end()
                if stop >= 0:
                    blocks.append((key.start(), stop))
                    if "PRIVATE KEY" in key[1]:
                        # a key on one line is the whole block, any other begins with its header line
                        tail = re.search(r'[\s"]', text[key.end() : header_end])
                        end = stop if stop <= m.end(1) else key.end() + tail.start() if tail else header_end
                        yield number, key.start(), end, stop, "private_key"
                    at = skip_to = max(skip_to, stop)
                    if stop > m.end(1):
                        break
            for a, b, kind in in_line(line):
                if any(x < offset + b and offset + a < y for x, y in blocks) or offset + a < skip_to and not blocks:
                    continue
                more = CONTINUED.match(line, b + 1) if line[b : b + 1] == '"' else None
                yield number, offset + a, offset + b, offset + (more.end() - 1 if more else b), kind
        if m.end() == len(text):
            break


def redact(text: str | None, mark: str = "***") -> str | None:
    """The text with every secret replaced by a mark; quotes, continuation bars and line ends stay."""
    if not text:
        return text
    out, pos = [], 0
    for _, start, _, last, kind in sorted(find_secrets(text), key=lambda x: (x[1], -x[3])):
        if start < pos:
            continue
        # of a secret over several lines or literals each part is masked; what joins the parts stays
        if kind == "private_key":
            masked = re.sub(r"[^\r\n|\s][^\r\n]*", mark, text[start:last])
        else:
            masked = '"'.join(part if k % 2 else mark for k, part in enumerate(text[start:last].split('"')))
        out += [text[pos:start], masked]
        pos = last
    return "".join(out) + text[pos:]


def secrets_of(df: DataFrame, key: str, code: str) -> DataFrame:
    """rec_id, line_no, secret, kind: distinct per record, in one pass without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch[key], batch[code]):
                if isinstance(text, str):
                    rows += {(k, n, text[a:b], kind) for n, a, b, _, kind in find_secrets(text)}
            yield pd.DataFrame(rows, columns=["rec_id", "line_no", "secret", "kind"])

    return df.select(F.col(key).cast("bigint").alias(key), code).mapInPandas(run, "rec_id bigint, line_no int, secret string, kind string")


def redacted(df: DataFrame, code: str, out: str = "redacted") -> DataFrame:
    """df with the redacted source as ``out`` (null for null)."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: redact(t) if isinstance(t, str) else None)

    return df.withColumn(out, mask(F.col(code)))
