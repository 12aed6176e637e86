"""Encoding of a whole corpus with a public byte-pair vocabulary.

A text is cut into pieces by the vocabulary's pattern; within a piece, a segment tree over byte positions
holds for every live position the rank of the pair that starts there.  Its root is the leftmost pair of
smallest rank; a merge is three point updates (the merged position, its left live neighbour, and the right
part, which dies), so a piece of n bytes takes O(n log n) however long it is.  Short pieces are remembered
per worker up to a fixed number.  The kernel runs in Arrow batches over the scan's own splits: no shuffle.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.names import free_name

# Fixed value: the pattern that goes with the byte-level vocabularies of 50k entries.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = 1 << 62
_SHORT = 48  # bytes of a piece that is worth remembering
_REMEMBERED = 400_000
_POSITION_BITS = 40


class BytePairs:
    """One vocabulary with its merge machinery."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self._pairs: dict[int, int] = {}
        self._seen: dict[str, array] = {}

    def _pair(self, left: int, right: int) -> int:
        """The rank of two neighbours' union, or _NONE."""
        key = (left << 20) | right
        rank = self._pairs.get(key)
        if rank is None:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right], _NONE)
            if len(self._pairs) >= 2_000_000:
                self._pairs.clear()
            self._pairs[key] = rank
        return rank

    def merge(self, piece: bytes) -> array:
        """Ids of one piece, by the segment tree of pair ranks."""
        n = len(piece)
        ids = [self.single[b] for b in piece]
        if n == 1:
            return array("i", ids)
        after = list(range(1, n + 1))  # live right neighbour; n: none
        before = list(range(-1, n - 1))
        leaves = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * leaves)
        pair = self._pair
        for i in range(n - 1):
            rank = pair(ids[i], ids[i + 1])
            if rank != _NONE:
                tree[leaves + i] = (rank << _POSITION_BITS) | i
        for node in range(leaves - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

        def put(position: int, value: int) -> None:
            node = leaves + position
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                value = left if left < right else right
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        mask = (1 << _POSITION_BITS) - 1
        while (best := tree[1]) != _NONE:
            at = best & mask
            ids[at] = best >> _POSITION_BITS
            gone = after[at]
            beyond = after[gone]
            after[at] = beyond
            ids[gone] = -1
            if gone < n - 1:
                put(gone, _NONE)
            if beyond < n:
                before[beyond] = at
                rank = pair(ids[at], ids[beyond])
                put(at, _NONE if rank == _NONE else (rank << _POSITION_BITS) | at)
            else:
                put(at, _NONE)
            back = before[at]
            if back >= 0:
                rank = pair(ids[back], ids[at])
                put(back, _NONE if rank == _NONE else (rank << _POSITION_BITS) | back)
        return array("i", [i for i in ids if i >= 0])

    def encode(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        seen = self._seen
        for piece in self.split(text):
            ids = seen.get(piece)
            if ids is None:
                raw = piece.encode("utf-8")
                ids = self.merge(raw)
                if len(raw) <= _SHORT:
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            out.extend(ids)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


def encode_corpus(documents: DataFrame, text: str, vocabulary_path: str, ids: str = "ids") -> DataFrame:
    """``documents`` with a column of the token ids of ``text`` (array<int>), without special tokens.

    A null or empty text has the empty list; white space is text like any other.  Strings that look like special
    tokens are ordinary text.  All other columns pass through; if one is called ``ids`` the new one gets a number.
    """
    name = free_name(ids, documents.columns)
    field = T.StructField(name, T.ArrayType(T.IntegerType(), False), False)
    schema = T.StructType([*documents.schema.fields, field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary(vocabulary_path)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for value in batch.column(text_at):
                plain = value.as_py()
                if plain:
                    pairs.encode(plain, flat)
                offsets.append(len(flat))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=[*batch.schema.names, name])

    text_at = documents.columns.index(text)
    return documents.mapInArrow(run, schema)


def token_counts(documents: DataFrame, text: str, vocabulary_path: str, count: str = "n_tokens") -> DataFrame:
    """``documents`` without ``text``, with the number of its tokens (bigint; 0 for a null or empty text)."""
    name = free_name(count, documents.columns)
    coded = encode_corpus(documents, text, vocabulary_path, free_name("ids__", documents.columns))
    return coded.withColumn(name, F.size(coded.columns[-1]).cast("bigint")).drop(coded.columns[-1], text)
