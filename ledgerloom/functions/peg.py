"""Parsing expression grammars that compile to one Java regular expression.

Ordered choice becomes an atomic group of alternatives, repetition becomes a possessive quantifier and the predicates
become look-aheads, so the compiled pattern commits exactly where a PEG commits and never backtracks into a finished
alternative.  The JVM runs it inside a Spark expression; possessive loops are iterative there, so long inputs cannot
overflow the stack.
"""

from __future__ import annotations


def seq(*parts: str) -> str:
    return "".join(parts)


def choice(*alternatives: str) -> str:
    """Ordered choice: the first alternative that matches wins for good."""
    return "(?>" + "|".join(alternatives) + ")"


def star(part: str) -> str:
    return f"(?:{part})*+"


def plus(part: str) -> str:
    return f"(?:{part})++"


def opt(part: str) -> str:
    return f"(?:{part})?+"


def ahead(part: str) -> str:
    return f"(?={part})"


def without(part: str) -> str:
    return f"(?!{part})"
