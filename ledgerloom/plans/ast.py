"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    value: Any


@dataclass
class Param:
    name: str


@dataclass
class Name:
    parts: list[str]


@dataclass
class Star:
    table: str | None = None


@dataclass
class Call:
    func: str
    args: list
    distinct: bool = False


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Unary:
    op: str
    arg: Any


@dataclass
class Case:
    base: Any
    whens: list
    otherwise: Any


@dataclass
class Cast:
    arg: Any
    kind: str
    params: list
    path: list[str] = field(default_factory=list)


@dataclass
class Between:
    arg: Any
    low: Any
    high: Any


@dataclass
class Like:
    arg: Any
    pattern: Any
    escape: str | None


@dataclass
class IsNull:
    arg: Any


@dataclass
class In:
    args: list
    items: list | None
    query: Any = None
    hierarchy: bool = False


@dataclass
class Refs:
    arg: Any
    table: list[str]


@dataclass
class Scalar:
    query: Any


@dataclass
class Nested:
    """A tabular section as a column: ``Table.Section.(fields)``."""

    parts: list[str]
    fields: list


@dataclass
class Field:
    expr: Any
    alias: str | None


@dataclass
class Table:
    parts: list[str]
    alias: str | None
    args: list | None = None  # arguments of a virtual table
    param: bool = False


@dataclass
class Derived:
    query: Any
    alias: str


@dataclass
class Join:
    kind: str
    left: Any
    right: Any
    on: Any


@dataclass
class Total:
    expr: Any
    alias: str | None
    hierarchy: str | None = None
    periods: tuple | None = None


@dataclass
class Select:
    fields: list[Field]
    sources: list
    distinct: bool = False
    top: int | None = None
    allowed: bool = False
    into: str | None = None
    add: bool = False
    where: Any = None
    group: list = field(default_factory=list)
    sets: list | None = None
    having: Any = None
    index: list = field(default_factory=list)
    index_unique: bool = False
    for_update: bool = False


@dataclass
class Query:
    """Branches of a union with what applies to the whole."""

    branches: list  # (all: bool, Select)
    order: list = field(default_factory=list)  # (expr, desc, hierarchy)
    autoorder: bool = False
    totals: list | None = None  # totals fields
    totals_by: list = field(default_factory=list)
    overall: bool = False


@dataclass
class Drop:
    name: str
