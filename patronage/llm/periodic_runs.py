"""Periodic runs of words, found from Lyndon roots, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends, at least ``FEWEST_WORDS`` and ``FEWEST_PERIODS`` periods long. Per text:

1. Words that occur fewer than four times lie in no run, so they cut the text; this is
   repeated on the pieces. What is left are stretches of frequent words.
2. Baier's grouping, the first phase of his suffix sorter, gives the longest Lyndon word
   at each position: groups of suffixes are taken from the greatest down, each hands its
   context on to the nearest position before it in a lower group, which by that moves to
   a new group just above its own. What a context is when its group is taken is the
   longest Lyndon word there. Done for the order of the words' numbers and for the
   opposite one.
3. Every run holds its Lyndon roots under one of the two orders, and with four periods or
   more two of them side by side. Such neighbours are extended to both sides as far as
   the words one period apart agree (LCE), which gives the whole run.

Each text is worked on by itself, in time in proportion to its words (step 3 to the sum of the
lengths of its runs), without a shuffle; a task holds the words of one text.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed
text; ties for the strongest run go to the smaller start, then the smaller period; repeated
rows get equal results; a null key keeps its row (and ``restated`` leaves its text as it
is); an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import keyed_texts, slices

FEWEST_WORDS = 6
FEWEST_PERIODS = 4
#: How often pieces are cut again. Any number gives the same runs.
CUTS = 3
_STRETCH = re.compile(b"\x01{%d,}" % FEWEST_WORDS)

Run = tuple[int, int, int]  # first word, end, period


def lyndon_lengths(text: list[int], n_symbols: int) -> list[int]:
    """Length of the longest Lyndon word at each position, by grouping alone.

    ``text`` holds the numbers 0 to ``n_symbols`` - 1. Groups form a list from low to high."""
    n = len(text)
    group = list(text)
    members: list[list[int]] = [[] for _ in range(n_symbols)]
    for i, symbol in enumerate(text):
        members[symbol].append(i)
    size = [1] * n_symbols
    below = list(range(-1, n_symbols - 1))
    above = [*range(1, n_symbols), -1]
    # Positions of groups not yet taken, as a list of neighbours.
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    out = [1] * n
    current = n_symbols - 1
    while current >= 0:
        own = size[current]
        receivers: list[int] = []
        times: list[int] = []
        last = -1
        for i in members[current]:
            if group[i] != current:
                continue
            out[i] = own
            before, after = left[i], right[i]
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                if before == last:
                    times[-1] += 1
                else:
                    receivers.append(before)
                    times.append(1)
                    last = before
        members[current] = []
        moves = zip(times, receivers, strict=True)
        if len(times) > 1 and max(times) > 1:
            moves = sorted(moves, key=lambda move: -move[0])  # more copies of the context are greater
        new: dict[tuple[int, int], int] = {}
        for k, j in moves:
            old = group[j]
            to = new.get((old, k))
            if to is None:
                to = new[old, k] = len(size)
                size.append(size[old] + k * own)
                members.append([])
                higher = above[old]
                above.append(higher)
                below.append(old)
                above[old] = to
                if higher >= 0:
                    below[higher] = to
            group[j] = to
            members[to].append(j)
        current = below[current]
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Number of leading entries that agree."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        end = min(n, at + step)
        differ = a[at:end] != b[at:end]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, 2 * step
    return n


def _roots_extended(text: np.ndarray, lengths: np.ndarray) -> Iterator[Run]:
    """Runs whose Lyndon roots ``lengths`` shows, two of them side by side at least."""
    n = len(text)
    at = np.flatnonzero(np.arange(n) + lengths < n)
    following = at + lengths[at]
    at = at[(lengths[following] == lengths[at]) & (text[following] == text[at])]
    reached: dict[int, int] = {}
    for i, period in zip(at.tolist(), lengths[at].tolist(), strict=True):
        if i + period <= reached.get(period, 0):
            continue  # a root of the run found last
        start = i - agreement(text[:i][::-1], text[: i + period][::-1])
        end = i + period + agreement(text[i:], text[i + period :])
        if end - start >= 2 * period:
            reached[period] = end
            if end - start >= max(FEWEST_WORDS, FEWEST_PERIODS * period):
                yield start, end, period


def stretches(words: list[bytes], first: int = 0, cuts: int = CUTS) -> Iterator[tuple[int, list[bytes]]]:
    """(number of its first word, words) of the stretches that may hold runs."""
    often = Counter(words)
    frequent = bytes([often[word] >= FEWEST_PERIODS for word in words])
    for found in _STRETCH.finditer(frequent):
        start, end = found.span()
        if end - start == len(words) or not cuts:
            yield first + start, words[start:end]
        else:
            yield from stretches(words[start:end], first + start, cuts - 1)


def runs(words: list[bytes]) -> list[Run]:
    """All runs, by start and then period."""
    found: set[Run] = set()
    for first, part in stretches(words):
        numbers = {word: k for k, word in enumerate(sorted(set(part)))}
        top = len(numbers) - 1
        text = [numbers[word] for word in part]
        array = np.array(text, np.int32)
        for symbols in (text, [top - k for k in text]):
            lengths = np.array(lyndon_lengths(symbols, top + 1))
            found.update((first + start, first + end, period) for start, end, period in _roots_extended(array, lengths))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not found:
        return words
    keep = bytearray(b"\x01") * len(words)
    for start, end, period in found:
        keep[start + period : end] = bytes(end - start - period)
    return list(compress(words, keep))


def restated(words: list[bytes], key: str | None) -> list[bytes]:
    """The words, for one key in ten with an ending that repeats itself.

    With h the CRC-32 of the key, g = h // 10, n words and h % 10 = 0, the words from a = g % n
    on repeat their first 1 + (n - a) // (3 + g % 8)."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + period]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


RUNS = "runs array<struct<start:long,length:long,period:long>>"


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed text of every row.

    ``repeat`` gives the texts of a tenth of the keys a periodic ending first (``restated``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
        for batch in batches:
            for part in slices(batch, "text"):
                found, left = [], []
                for name, value in zip(part.column("name").to_pylist(), part.column("text"), strict=True):
                    words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                    if repeat:
                        words = restated(words, name)
                    some = runs(words)
                    found.append([{"start": s, "length": e - s, "period": q} for s, e, q in some])
                    left.append(b" ".join(collapse(words, some)))
                collapsed = pa.array(left, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind), collapsed], ["doc_id", "runs", "collapsed"])

    docs = keyed_texts(df, key, text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    return named.mapInArrow(run, f"doc_id {kind}, {RUNS}, collapsed string")


def report(found: DataFrame) -> DataFrame:
    """Of ``find_runs``: n_runs, the strongest run (greatest length / period) and digests."""
    stronger = F.array_sort(
        "runs",
        lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.sign(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"))
        .when(x["start"] != y["start"], F.sign(x["start"] - y["start"]).cast("int"))
        .otherwise(F.sign(x["period"] - y["period"]).cast("int")),
    )
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", F.try_element_at(stronger, F.lit(1)).alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def run_digests(df: DataFrame) -> DataFrame:
    return report(find_runs(df, repeat=True))
