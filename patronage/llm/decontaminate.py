"""Benchmark passages in documents, verbatim or with a few words changed.

Texts are words here, lower-cased. A CGK random walk over a sequence writes the word
under the cursor at each step and moves on if a random bit of that word and step says
so; two sequences of small edit distance then agree in most steps. A hash is a walk
with sampled steps; a window of a document and an item collide if the words at the
sampled steps agree. Items are embedded from many anchors, each document from every
word, so a window has the size of the item it collides with. Sampled steps and anchors
go by classes of length, so that walks stay inside short items. The number of walks of a
class follows from a target recall at the full share of edits, measured on randomly edited
items; a warning says so where MOST_WALKS don't reach it. One walk that moves at every step
finds each item that stands verbatim, whatever its words. Each collision is verified by the
exact edit distance of the item to the window.

A walk is cut short at the first sampled step where no item agrees, which changes no
collision and saves nearly all steps.

Defined results: null and empty documents and items match nothing; equal items are
all reported; an item shorter than MIN_WORDS matches only as it is; each row is judged by
its own text and gives a row, also where keys are null or repeated. Items go to the executors
in blocks of a fixed number of words.
"""

from __future__ import annotations

import random
import warnings
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import keyed_texts, mix64, slices, tidy
from patronage.llm.shingles import RUN_BYTES, word_hashes

#: Edited words that a passage may have, as a share of the item's words.
EDITS = 0.2
MIN_WORDS = 8
TARGET_RECALL = 0.98
MOST_WALKS = 32
#: Classes of items: least number of words, ranges of the sampled steps, words between anchors.
CLASSES = (
    (MIN_WORDS, ((0, 1), (1, 3), (3, 5)), 1),
    (12, ((0, 1), (1, 4), (4, 7)), 2),
    (24, ((0, 1), (1, 4), (4, 7), (7, 10)), 3),
)
#: Steps of the walk that never stays.
STRAIGHT = (0, 2, 4, MIN_WORDS - 1)
#: Items and edited forms of each that the number of walks is measured on.
PROBES = (150, 2)
#: Items sent along at once, about 10 MB.
BLOCK_WORDS = 400_000
_TABLE_BITS = 18
LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    hashes, ends = word_hashes(pa.array(texts, pa.string()))
    return np.split(hashes, ends[:-1]) if len(texts) else []


def _class_of(n: int) -> int:
    return sum(n >= least for least, _, _ in CLASSES) - 1


def _walk_words(words: np.ndarray, walk: int) -> np.ndarray:
    """The random bits of each word in a walk."""
    return mix64(words ^ mix64(np.array([walk + 1], np.uint64)))


@dataclass
class Walk:
    number: int
    steps: tuple[int, ...]
    #: Class of the items it is for; None for the walk that never stays.
    kind: int | None
    #: Per sampled step, which hashes of the words so far some item has.
    alive: list[np.ndarray] = field(default_factory=list)
    keys: np.ndarray = field(default_factory=lambda: np.array([], np.uint64))
    #: Item and anchor of each key.
    items: np.ndarray = field(default_factory=lambda: np.array([], np.int64))
    anchors: np.ndarray = field(default_factory=lambda: np.array([], np.int64))

    def anchors_of(self, size: int) -> range:
        return range(1) if self.kind is None else range(0, size, CLASSES[self.kind][2])

    def moves(self, words: np.ndarray, step: int) -> np.ndarray:
        """How far the cursor goes on from each of the words, which are those of _walk_words."""
        if self.kind is None:
            return np.ones(len(words), np.int64)
        return ((words >> np.uint64(step)) & np.uint64(1)).astype(np.int64)


def _walk(kind: int | None, turn: int) -> Walk:
    if kind is None:
        return Walk(0, STRAIGHT, None)
    number = 1 + kind * MOST_WALKS + turn
    chosen = random.Random(number)
    return Walk(number, tuple(chosen.randrange(low, high) for low, high in CLASSES[kind][1]), kind)


def _add(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(hashes ^ words)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class Items:
    """Hash tables of a block of items, with the walks of each class."""

    def __init__(self, ids: list[int], words: list[np.ndarray], walks: list[Walk]):
        self.ids, self.words, self.walks = ids, words, walks
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        kinds = np.array([_class_of(len(x)) for x in words], np.int64)
        for walk in walks:
            self._fill(walk, np.flatnonzero(kinds >= 0 if walk.kind is None else kinds == walk.kind))
        for item, x in enumerate(words):
            if 0 < len(x) < MIN_WORDS:
                self.short[len(x)].setdefault(x.tobytes(), []).append(item)

    def _fill(self, walk: Walk, chosen: np.ndarray) -> None:
        """Walk all chosen items at once; one that leaves its item before the last sampled step has no key."""
        places = [(k, anchor) for k in chosen.tolist() for anchor in walk.anchors_of(len(self.words[k]))]
        if not places:
            return
        flat = np.concatenate([self.words[k] for k in chosen])
        sizes = np.array([len(self.words[k]) for k in chosen])
        last = np.zeros(len(self.words), np.int64)
        last[chosen] = np.cumsum(sizes)
        item, anchor = np.array(places, np.int64).T
        at = last[item] - np.array([len(x) for x in self.words])[item] + anchor
        bits, hashed = _walk_words(flat, walk.number), np.zeros(len(at), np.uint64)
        walk.alive = [np.zeros(1 << _TABLE_BITS, bool) for _ in walk.steps]
        tables, seen = iter(walk.alive), []
        for step in range(walk.steps[-1] + 1):
            inside = at < last[item]
            item, anchor, at, hashed = item[inside], anchor[inside], at[inside], hashed[inside]
            seen = [x[inside] for x in seen]
            if step in walk.steps:
                hashed = _add(hashed, flat[at])
                seen.append(_cell(hashed))
            at = at + walk.moves(bits[at], step)
        for cells in seen:
            next(tables)[cells] = True
        order = np.argsort(hashed, kind="stable")
        walk.keys, walk.items, walk.anchors = hashed[order], item[order], anchor[order]

    def collisions(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, word where its window starts) for a run of words of one or more documents."""
        found: set[tuple[int, int]] = set()
        padded = np.concatenate([words, np.zeros(1 + max((walk.steps[-1] for walk in self.walks), default=0), np.uint64)])
        for walk in self.walks:
            if not len(walk.keys):
                continue
            start = np.arange(len(words))
            at, hashed, tables = start, np.zeros(len(words), np.uint64), iter(walk.alive)
            for step in range(walk.steps[-1] + 1):
                if step in walk.steps:
                    hashed = _add(hashed, padded[at])
                    alive = np.flatnonzero(next(tables)[_cell(hashed)])
                    start, at, hashed = start[alive], at[alive], hashed[alive]
                # Few words are left after the first step, so their bits are made here.
                at = at + walk.moves(_walk_words(padded[at], walk.number), step)
            low, high = (np.searchsorted(walk.keys, hashed, side) for side in ("left", "right"))
            for i in np.flatnonzero(low < high).tolist():
                for k in range(low[i], high[i]):
                    found.add((int(walk.items[k]), int(start[i] - walk.anchors[k])))
        for size, items in self.short.items():
            if len(words) >= size:
                firsts = np.isin(words[: len(words) - size + 1], np.array([np.frombuffer(k, np.uint64)[0] for k in items]))
                for start in np.flatnonzero(firsts).tolist():
                    found.update((item, start) for item in items.get(words[start : start + size].tobytes(), ()))
        return found


def fitting_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Least edits that turn ``item`` into a part of ``window``, and where that part ends."""
    columns = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    for word in item:
        changed = np.empty_like(row)
        changed[0] = row[0] + 1
        changed[1:] = np.minimum(row[:-1] + (window != word), row[1:] + 1)
        row = np.minimum.accumulate(changed - columns) + columns
    end = int(row.argmin())
    return int(row[end]), end


def matches(items: Items, words: np.ndarray, ends: np.ndarray) -> list[dict[int, int]]:
    """For each document of a run, the items in it with the least edits found."""
    out: list[dict[int, int]] = [{} for _ in ends]
    starts = np.concatenate([[0], ends[:-1]])

    def verify(item: int, doc: int, first: int, last: int, allowed: int) -> None:
        own = items.words[item]
        window = words[max(first - allowed, int(starts[doc])) : min(last + len(own) + allowed, int(ends[doc]))]
        # Each word that the window lacks is an edit.
        if out[doc].get(item) == 0 or np.count_nonzero(~np.isin(own, window)) > allowed:
            return
        edits, _ = fitting_distance(own, window)
        if edits <= allowed:
            out[doc][item] = min(edits, out[doc].get(item, edits))

    run: list[int] | None = None
    for item, start in sorted(items.collisions(words)):
        size = len(items.words[item])
        allowed = int(EDITS * size) if size >= MIN_WORDS else 0
        middle = min(max(start + size // 2, 0), len(words) - 1)
        doc = int(np.searchsorted(ends, middle, "right"))
        # Neighbouring windows of an item are verified as one.
        if run and run[:2] == [item, doc] and start - run[3] <= allowed:
            run[3] = start
            continue
        if run:
            verify(*run)
        run = [item, doc, start, start, allowed]
    if run:
        verify(*run)
    return out


def _edited(words: np.ndarray, chosen: random.Random) -> np.ndarray:
    """As many edits as an item may have, at random places."""
    out = [int(w) for w in words]
    for _ in range(int(EDITS * len(words))):
        at, kind = chosen.randrange(len(out)), chosen.randrange(3)
        out[at : at + (kind < 2)] = [chosen.getrandbits(64)] * (kind != 1)
    return np.array(out, np.uint64)


def walks_needed(words: list[np.ndarray]) -> list[Walk]:
    """The straight walk, and for each class as many walks as find TARGET_RECALL of edited items."""
    chosen, walks = random.Random(7), [_walk(None, 0)]
    most, forms = PROBES
    for kind in range(len(CLASSES)):
        own = [x for x in words if _class_of(len(x)) == kind]
        if not own:
            continue
        sample = chosen.sample(own, min(most, len(own))) * forms
        edited = [_edited(x, chosen) for x in sample]
        gap = np.array([chosen.getrandbits(64) for _ in range(MIN_WORDS)], np.uint64)
        flat = np.concatenate([x for text in edited for x in (text, gap)])
        first = np.cumsum([0, *(len(text) + len(gap) for text in edited)])
        missing = set(range(len(sample)))
        for turn in range(MOST_WALKS):
            walk = _walk(kind, turn)
            for item, start in Items([], sample, [walk]).collisions(flat):
                if first[item] - len(sample[item]) < start < first[item + 1]:
                    missing.discard(item)
            walks.append(_walk(kind, turn))
            if len(missing) <= (1 - TARGET_RECALL) * len(sample):
                break
        else:
            warnings.warn(f"{MOST_WALKS} walks find {1 - len(missing) / len(sample):.3f} of edited items of class {kind}", stacklevel=2)
    return walks


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").dropna().orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += row.text.count(" ") + 1
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _found(items: Items, part: pa.RecordBatch, column: str) -> list[dict[int, int]]:
    words, ends = word_hashes(part.column(column))
    return matches(items, words, ends) if len(words) else [{}] * part.num_rows


def _shared(df: DataFrame, ids: list[int], texts: list[str]):
    """A block for the executors: its texts (BLOCK_WORDS words) and the classes and turns of its walks."""
    walks = [(walk.kind, turn) for walk, turn in _turns(walks_needed(words_of(texts)))]
    return df.sparkSession.sparkContext.broadcast((ids, texts, walks))


def _turns(walks: list[Walk]) -> Iterator[tuple[Walk, int]]:
    seen: dict[int | None, int] = defaultdict(int)
    for walk in walks:
        yield walk, seen[walk.kind]
        seen[walk.kind] += 1


def _opened(block: tuple[list[int], list[str], list[tuple[int | None, int]]]) -> Items:
    ids, texts, walks = block
    return Items(ids, words_of(texts), [_walk(*walk) for walk in walks])


def _with_block(docs: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    """Append the leaks of a block of items to those of each row."""
    shared = _shared(docs, ids, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(shared.value)
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                before = part.column("leaks").to_pylist()
                rows = [
                    x + [{"item_id": items.ids[k], "edits": edits} for k, edits in sorted(y.items())]
                    for x, y in zip(before, _found(items, part, "text"), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(rows, LEAKS)], ["doc_id", "text", "leaks"])

    return docs.mapInArrow(tidy(run), docs.schema)


def find_leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and leaks (item_id, edits), one row per row of ``df``."""
    out = keyed_texts(df, key, text).withColumn("leaks", F.array().cast("array<struct<item_id: long, edits: int>>"))
    for ids, texts in _blocks(items):
        out = _with_block(out, ids, texts)
    return out.select("doc_id", "leaks")


def leaks_by_document(df: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (comma-joined) for every row."""
    listed = find_leaks(df, items).select("doc_id", F.array_sort(F.array_distinct("leaks.item_id")).alias("items"))
    return listed.select(
        "doc_id",
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.concat_ws(",", F.col("items").cast("array<string>")).alias("item_ids"),
    )


def remove_contaminated(df: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``df`` in which no item was found."""
    out = df
    for ids, texts in _blocks(items):
        out = _filtered(out, ids, texts)
    return out


def _filtered(df: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    shared = _shared(df, ids, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _opened(shared.value)
        for batch in batches:
            for part in slices(batch, "text", RUN_BYTES):
                yield part.filter(pa.array([not x for x in _found(items, part, "text")], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
