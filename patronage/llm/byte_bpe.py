"""Byte-level BPE encoding and decoding over padded matrices.

A text is split by the tokenizer's pattern. The distinct pieces that a task has not
met yet are laid out as byte rows of matrices, one for each range of lengths; in each
round every row merges its leftmost pair of minimum rank, rows close up, and finished
rows leave the matrix. Ranks of pairs come from a hashed table.

Defined results: null and empty texts have no ids; repeated rows give repeated
results; the order and number of rows do not matter. Other columns are kept by
``encode`` and ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from patronage.llm.common import keyed_texts, slices, texts, tidy, vocabulary
from patronage.llm.pair_table import NONE, PairTable

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a task remembers; when there are more, it starts anew. Results do not depend on it.
REMEMBERED = 150_000
#: Cells of a matrix.
CELLS = 1 << 20
#: Longest piece laid out as a row; longer ones follow the same rule with a heap.
ROW_BYTES = 2048


class ByteBPE:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.split = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ranks[token[:cut]], ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        left, right, merged = np.array(pairs, np.int32).T
        self.pairs = PairTable(left, right, merged)
        self.known: dict[str, bytes] = {}

    def pieces(self, rows: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(rows)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        order = np.argsort(lengths, kind="stable")
        ordered, at = lengths[order], 0
        end_of_rows = int(np.searchsorted(ordered, ROW_BYTES, "right"))
        while at < end_of_rows:
            widest = int(ordered[at]) * 5 // 4
            end = min(end_of_rows, int(np.searchsorted(ordered, widest, "right")), at + max(1, CELLS // max(1, widest)))
            names = order[at:end]
            self._matrix([rows[i] for i in names.tolist()], lengths[names], names, out)
            at = end
        for i, row in enumerate(rows):
            if len(row) > ROW_BYTES:
                out[i] = self._long(row)
        return out

    def _matrix(self, rows: list[bytes], lengths: np.ndarray, name: np.ndarray, out: list[bytes]) -> None:
        width = int(lengths.max())
        flat = np.frombuffer(b"".join(row.ljust(width, b"\0") for row in rows), np.uint8)
        symbols = self.byte[flat].reshape(len(rows), width)
        symbols[np.arange(width) >= lengths[:, None]] = -1
        ranks = np.full(symbols.shape, NONE, np.int32)  # of each symbol with the next
        if width > 1:
            ranks[:, :-1] = self.pairs.get(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), -1)
        columns = np.arange(width)
        while len(name):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(name)), at]
            done = best == NONE
            if done.any():
                ended = symbols[done]
                filled = ended >= 0
                ids = ended[filled].tobytes()
                ends = (4 * np.cumsum(filled.sum(axis=1))).tolist()
                for i, start, end in zip(name[done].tolist(), [0, *ends], ends, strict=False):
                    out[i] = ids[start:end]
                live = ~done
                symbols, ranks, name, at, best = symbols[live], ranks[live], name[live], at[live], best[live]
                if not len(name):
                    break
                width = int((symbols >= 0).sum(axis=1).max())
                symbols, ranks, columns = symbols[:, :width], ranks[:, :width], columns[:width]
            row = np.arange(len(name))
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            symbols = np.take_along_axis(symbols, source, axis=1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            symbols[:, -1] = -1
            ranks[:, -1] = NONE
            symbols[row, at] = best
            following = np.where(at + 1 < width, symbols[row, np.minimum(at + 1, width - 1)], -1)
            ranks[row, at] = self.pairs.get(best, following)
            inner = np.flatnonzero(at)
            before = at[inner] - 1
            ranks[inner, before] = self.pairs.get(symbols[inner, before], best[inner])

    def _long(self, piece: bytes) -> bytes:
        symbols = self.byte[np.frombuffer(piece, np.uint8)]
        first = self.pairs.get(symbols[:-1], symbols[1:])
        heap = [(int(rank), int(i)) for i, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        rank, value = first.tolist() + [int(NONE)], symbols.tolist()
        after, before = list(range(1, len(value) + 1)), list(range(-1, len(value) - 1))
        values, keys, mask = self.pairs.values, self.pairs.keys, int(self.pairs.mask)

        def merged(a: int, b: int) -> int:
            key = (a << 32) | b
            slot = ((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> (64 - self.pairs.bits)
            while keys[slot] != key:
                if keys[slot] == -1:
                    return int(NONE)
                slot = (slot + 1) & mask
            return int(values[slot])

        while heap:
            best, i = heapq.heappop(heap)
            if value[i] < 0 or rank[i] != best:
                continue
            j = after[i]
            value[i], value[j], after[i] = best, -1, after[j]
            if after[i] < len(value):
                before[after[i]] = i
            for k in (i, before[i]):
                if k < 0:
                    continue
                rank[k] = merged(value[k], value[after[k]]) if after[k] < len(value) else int(NONE)
                if rank[k] != NONE:
                    heapq.heappush(heap, (rank[k], k))
        return np.array([x for x in value if x >= 0], np.int32).tobytes()

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        words = [self.split(row) for row in rows]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*words) - self.known.keys())
        self.known.update(zip(new, self.pieces([word.encode() for word in new]), strict=True))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, row)), np.int32) for row in words]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def _bpe(file: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(file, pattern)


def _shared(df: DataFrame, vocab: str):
    return df.sparkSession.sparkContext.broadcast(vocabulary(vocab))  # under 1 MB, whatever the input


def encode(
    df: DataFrame, text: str = "text", ids: str = "ids", vocab: str = VOCABULARY, same: str | None = None
) -> DataFrame:
    """All columns of ``df`` and the token ids of ``text``; a column named as ``ids`` is replaced.

    ``same`` names a further column that says whether the ids decode to the text."""
    rest = df.drop(ids, *([same] if same else []))
    shared = _shared(df, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(*shared.value)
        for batch in batches:
            for part in slices(batch, text):
                found = bpe.encode(texts(part.column(text)))
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                column = pa.ListArray.from_arrays(ends, np.concatenate([*found, np.array([], np.int32)]).astype(np.int32))
                added = [column]
                if same:
                    rows = zip(texts(part.column(text)), found, strict=True)
                    added.append(pa.array([bpe.decode(x.tolist()) == row.encode() for row, x in rows], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, ids, *([same] if same else [])])

    fields = [StructField(ids, ArrayType(IntegerType())), *([StructField(same, BooleanType())] if same else [])]
    return rest.mapInArrow(tidy(run), StructType([*rest.schema.fields, *fields]))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocab: str = VOCABULARY) -> DataFrame:
    """All columns of ``df`` and the bytes that ``ids`` stand for (null: none)."""
    rest = df.drop(out)
    shared = _shared(df, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(*shared.value)
        for batch in batches:
            column = pa.array([bpe.decode(row or []) for row in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return rest.mapInArrow(tidy(run), StructType([*rest.schema.fields, StructField(out, BinaryType())]))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCABULARY) -> DataFrame:
    """Number of tokens, and digests of the ids and of the bytes decoded from them."""
    shared = _shared(df, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(*shared.value)
        decimal = {i: str(i) for i in bpe.token}.__getitem__
        for batch in batches:
            for part in slices(batch, "text"):
                found = [ids.tolist() for ids in bpe.encode(texts(part.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(ids) for ids in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest() for ids in found], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(ids)).hexdigest() for ids in found], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    docs = keyed_texts(df, key, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
