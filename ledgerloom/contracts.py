"""What the parts of the engine that can be exchanged must offer."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Searcher(Protocol):
    """A search over an index: rows of key and score, best first or in any order."""

    def bm25(self, query: Sequence[str]) -> DataFrame: ...


@runtime_checkable
class Tokenizer(Protocol):
    """From a text column to its words."""

    def __call__(self, text: Column) -> Column: ...


@runtime_checkable
class QueryValidator(Protocol):
    def __call__(self, text: str, catalog: Any) -> list: ...


@runtime_checkable
class SourceReader(Protocol):
    """From files or rows of source code to a table of methods or calls."""

    def __call__(self, code: DataFrame, key: str, path: str, text: str) -> DataFrame: ...


@runtime_checkable
class MetadataReader(Protocol):
    def __call__(self, spark: Any, path: str) -> DataFrame: ...
