"""Encoding a corpus with a public byte-level BPE vocabulary.

Symbols of a piece are a doubly linked list; candidate merges wait in a priority queue ordered by (rank, position), and an
entry whose symbols have changed since it was queued is skipped as stale.  A piece of n bytes costs O(n log n), so a run of
a million equal characters is no special case.  Decoding concatenates the vocabulary strings.

Work is saved, not skipped: a pre-token never reaches over the border between a non-space and a following white-space
character, so texts are cut there (first at line ends, then at words) and the ids of repeated lines and words are looked
up.  The lookup tables are bounded and dropped when full.

Null and empty texts give an empty list of ids.  Strings that look like special tokens are ordinary text.  Lone surrogates
become U+FFFD, as in any UTF-8 text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD = regex.compile(r"\s*\S+|\s+")
CACHE_LINES, CACHE_PIECES, CACHED_LENGTH = 60_000, 400_000, 400
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


class BytePairEncoder:
    """Encoder and decoder of one vocabulary given as (bytes, rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(PRE_TOKEN)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.lines: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str) -> BytePairEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            a, b = part[i], part[j] if j < n else None
            if a is None or b is None or after[i] != j or len(a) + len(b) != size:
                continue  # stale: one of the two symbols has been merged since
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                right = part[after[i]]
                if (r := ranks.get(part[i] + right)) is not None:
                    heapq.heappush(queue, (r, i, after[i], size + len(right)))
            if before[i] >= 0:
                left = part[before[i]]
                if (r := ranks.get(left + part[i])) is not None:
                    heapq.heappush(queue, (r, before[i], i, len(left) + size))
        return [ranks[p] for p in part if p is not None]

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.pieces.get(word)
        if found is None:
            found = tuple(t for p in self.pattern.findall(word) for t in self.merge(p.encode("utf-8", "replace")))
            if len(word) <= CACHED_LENGTH:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[word] = found
        return found

    def _line(self, line: str) -> np.ndarray:
        found = self.lines.get(line)
        if found is None:
            found = np.array([t for w in WORD.findall(line) for t in self._word(w)], dtype=np.int32)
            if len(line) <= CACHED_LENGTH:
                if len(self.lines) >= CACHE_LINES:
                    self.lines.clear()
                self.lines[line] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.int32)
        parts, held = [], ""
        for k, line in enumerate(text.split("\n")):
            piece = "\n" + line if k else line
            if held and not held[-1].isspace():  # the border is \S | \n: no pre-token reaches over it
                parts.append(self._line(held))
                held = piece
            else:
                held += piece
        if held:
            parts.append(self._line(held))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def decode(self, ids) -> str:
        return b"".join(self.vocabulary[int(i)] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary."""
    return BytePairEncoder.load(path)


def vocabulary_path(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str, folder: str = TOKENIZERS) -> DataFrame:
    """key, ids of every row, in one pass without a shuffle."""
    path = vocabulary_path(vocabulary, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            keys, texts, start = batch.column(0), batch.column(1), 0
            while start < len(texts):  # a result batch holds about a million characters, however long the texts are
                size, stop = 0, start
                while stop < len(texts) and size < 1_000_000:
                    size += len(texts[stop].as_py() or "") + 1
                    stop += 1
                ids = [bpe.encode(t) for t in texts.slice(start, stop - start).to_pylist()]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])
                start = stop

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, vocabulary: str, out: str = "n_tokens", folder: str = TOKENIZERS) -> DataFrame:
    """df with the number of tokens of each text (0 for null and empty ones) as ``out`` (bigint)."""
    path = vocabulary_path(vocabulary, folder)

    @F.pandas_udf("bigint")
    def size(texts):
        bpe = encoder(path)
        return texts.map(lambda t: len(bpe.encode(t)) if isinstance(t, str) else 0).astype("int64")

    return df.withColumn(out, size(F.col(text)))
