"""Token counts for a sentence-piece BPE model by rank-synchronous merging of ragged arrays.

A blank stands for the model's mark of a word's start. No piece of the model has that
mark behind another character, so no merge crosses the start of a run of blanks:
texts are cut there, and each distinct segment is counted once. New segments lie one
after the other in a flat array; in each round every segment applies its pair of the
lowest rank wherever it occurs, the array closes up, and finished segments are
counted. Characters outside the vocabulary count as their UTF-8 bytes.

A segment of more than LONG_SEGMENT characters (unspaced scripts, encoded data) has rounds
of its own, in which places are kept by rank: a round touches only the pairs that it merges
and their neighbours, so time grows with the segment's length and not with its square.

Defined results: null and empty texts have no tokens; a text of one unbroken segment of any
length is counted whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from patronage.llm.common import keyed_texts, slices, texts, vocabulary
from patronage.llm.pair_table import NONE, PairTable

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
MARK = "▁"
#: Segments that a task remembers; when there are more, it starts anew.
REMEMBERED = 400_000
#: Segments with more characters keep their places by rank, and are not remembered.
LONG_SEGMENT = 2048
SEGMENT = re.compile(r" *[^ ]+| +")


class PieceCounter:
    def __init__(self, file: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        special = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
        pieces = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.vocab_size())
            if not any(test(i) for test in special)
        }
        if any(MARK in piece.lstrip(MARK) for piece in pieces):
            raise ValueError("the model merges across word starts; texts cannot be cut there")
        if model.encode("a  b", out_type=str)[0][:1] != MARK or model.encode("ﬁ", out_type=str)[-1] != "ﬁ":
            raise ValueError("the model changes texts before it splits them")
        chars = {char for piece in pieces for char in piece}
        symbols = sorted(pieces, key=lambda piece: pieces[piece])
        symbols += sorted(chars - pieces.keys())
        number = {symbol: i for i, symbol in enumerate(symbols)}
        pairs = [
            (number[piece[:cut]], number[piece[cut:]], number[piece])
            for piece in pieces
            for cut in range(1, len(piece))
            if piece[:cut] in number and piece[cut:] in number
        ]
        self.pairs = PairTable(*np.array(pairs, np.int32).T)
        self.codes = np.full(0x110000, -1, np.int32)
        for char in chars:
            self.codes[ord(char)] = number[char]
        self.codes[ord(" ")] = self.codes[ord(MARK)]
        # Tokens that a symbol counts for if it stays: bytes where it is no piece itself.
        self.weight = np.array([1 if symbol in pieces else len(symbol.encode()) for symbol in symbols], np.int64)
        self.known: dict[str, int] = {}

    def segments(self, rows: list[str]) -> np.ndarray:
        """Tokens of each segment, none of them empty."""
        points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.codes[points]
        lengths = np.array([len(row) for row in rows])
        owner = np.repeat(np.arange(len(rows)), lengths)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        out = np.bincount(owner, np.where(symbols < 0, width, 0), len(rows)).astype(np.int64)
        while len(symbols):
            ranks = np.full(len(symbols), NONE, np.int32)
            together = owner[:-1] == owner[1:]
            ranks[:-1][together] = self.pairs.get(symbols[:-1][together], symbols[1:][together])
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(starts, append=len(owner)))
            live = best != NONE
            if not live.all():
                ended = symbols[~live]
                kept = ended >= 0
                out += np.bincount(owner[~live][kept], self.weight[ended[kept]], len(rows)).astype(np.int64)
                symbols, owner, ranks, best = symbols[live], owner[live], ranks[live], best[live]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(ranks == best)
            # Of pairs that overlap, one after the other in a run, every second one merges.
            run_start = np.flatnonzero(np.diff(chosen, prepend=-2) != 1)
            offset = np.arange(len(chosen)) - np.repeat(run_start, np.diff(run_start, append=len(chosen)))
            chosen = chosen[offset % 2 == 0]
            symbols[chosen] = ranks[chosen]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def long_segment(self, row: str) -> int:
        """Tokens of one segment, by the same rounds over a linked list of its symbols."""
        points = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.codes[points]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        n = len(symbols)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ranks = np.full(n, NONE, np.int32)
        ranks[:-1] = self.pairs.get(symbols[:-1], symbols[1:])
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def keep(at: np.ndarray) -> None:
            at = at[ranks[at] != NONE]
            at = at[np.argsort(ranks[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(ranks[at])) + 1
            for part in np.split(at, cuts) if len(at) else ():
                rank = int(ranks[part[0]])
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(heap, rank)
                places[rank].append(part)

        keep(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            chosen = np.unique(np.concatenate(places.pop(rank)))
            # A place whose symbol or neighbour has merged since then has another rank now.
            chosen = chosen[ranks[chosen] == rank]
            if not len(chosen):
                continue
            # Of pairs that overlap, one after the other in a run, every second one merges.
            run_start = np.flatnonzero(np.append(True, after[chosen[:-1]] != chosen[1:]))
            offset = np.arange(len(chosen)) - np.repeat(run_start, np.diff(run_start, append=len(chosen)))
            chosen = chosen[offset % 2 == 0]
            gone = after[chosen]
            symbols[chosen] = rank
            symbols[gone], ranks[gone] = -2, NONE
            following = after[gone]
            after[chosen] = following
            inside = following < n
            before[following[inside]] = chosen[inside]
            changed = np.concatenate([chosen, before[chosen]])
            changed = np.unique(changed[changed >= 0])
            ranks[changed] = NONE
            paired = changed[after[changed] < n]
            ranks[paired] = self.pairs.get(symbols[paired], symbols[after[paired]])
            keep(changed)
        kept = symbols >= 0
        return int(self.weight[symbols[kept]].sum() + width[symbols == -1].sum())

    def _count(self, segment: str) -> int:
        known = self.known.get(segment)
        return self.long_segment(segment) if known is None else known

    def count(self, rows: list[str]) -> list[int]:
        parts = [SEGMENT.findall(" " + row.replace(MARK, " ")) if row else [] for row in rows]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [part for part in set().union(*parts) - self.known.keys() if len(part) <= LONG_SEGMENT]
        if new:
            self.known.update(zip(new, self.segments(new).tolist(), strict=True))
        return [sum(map(self._count, row)) for row in parts]


@lru_cache(maxsize=2)
def _counter(file: bytes) -> PieceCounter:
    return PieceCounter(file)


def count_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``, for every row."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(model)[0])  # half a MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = texts(part.column("text"))
                counts = np.array(counter.count(rows), np.int64)
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, pa.array(counts), pa.array(counts > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    docs = keyed_texts(df, key, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
