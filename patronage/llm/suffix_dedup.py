"""Bytes covered by long strings that occur elsewhere, by suffix arrays of shards.

Which suffixes can match at all is found first. Every text marks the block of least
hash among any RUN_BLOCKS successive ones (winnowing), so that two occurrences of a
LENGTH-byte string mark the same block at the same place in it. A block and the bytes
around it that such strings may reach are a context. Blocks marked once are done.
Equal contexts at different places are repeated in full. What remains, blocks that
several different contexts share, is dealt to shards by block.

A shard sorts the suffixes of its contexts by Larsson-Sadakane refinement, gets their
common prefixes by Kasai's method in step over all contexts, and reads off the strings
that start at different places. A block with very many contexts is spread over
several shards; these hand on their sorted strings, which are merged across shards by
binary search.

Defined results: null and empty texts have nothing to remove; texts below LENGTH bytes
are kept whole; equal texts of LENGTH bytes or more remove each other entirely; matches
may overlap, lie in one document and are judged on the input. Texts and places are
told apart by 64-bit digests. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import keyed_texts, mix64
from patronage.llm.id_filter import id_filter, passing
from patronage.session import materialize

LENGTH = 200
BLOCK = 100
RUN_BLOCKS = LENGTH - BLOCK + 1
#: Contexts of a shard, and of one block in a shard.
SHARD_CONTEXTS = 2000
BLOCK_CONTEXTS = 1500
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_UP = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + 8 * LENGTH, _BASE)]), dtype=np.uint64)
_DOWN = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + 8 * LENGTH, np.uint64(pow(int(_BASE), -1, 2**64)))]), dtype=np.uint64)


def text_digest(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little", signed=True)


def place(text: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A number for a byte of a text."""
    return mix64(text.astype(np.int64).view(np.uint64) + mix64(offset.astype(np.uint64) + _BASE)).view(np.int64)


class Hashes:
    """Hashes of any part of a run of bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _UP[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def marked_blocks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset, hash and context hash of each marked block of a text."""
    out = []
    last = len(data) - LENGTH  # where strings may start
    at = 0
    while at <= last:
        end = min(at + PIECE, last + 1)
        low, high = max(0, at - LENGTH), min(len(data), end + 3 * LENGTH)
        part = Hashes(data[low:high])
        starts = np.arange(at - low, end - low + RUN_BLOCKS - 1)
        blocks = part.of(starts, starts + BLOCK)
        # Ties go to the first block, so the low bits hold the place.
        least = (blocks & ~np.uint64(0x3FFFFF)) | np.arange(len(blocks), dtype=np.uint64)
        size = 1
        while size < RUN_BLOCKS:
            step = min(size, RUN_BLOCKS - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        chosen = np.unique(least & np.uint64(0x3FFFFF)).astype(np.int64)
        offsets = chosen + at
        before = np.minimum(offsets, LENGTH - BLOCK)
        start, stop = offsets - before, np.minimum(offsets + LENGTH, len(data))
        context = part.of(start - low, stop - low) + mix64(before.astype(np.uint64))
        out.append((offsets, blocks[chosen].view(np.int64), context.view(np.int64)))
        at = end
    if not out:
        return (np.array([], np.int64),) * 3
    offsets, blocks, contexts = (np.concatenate(x) for x in zip(*out, strict=True))
    _, once = np.unique(offsets, return_index=True)
    return offsets[once], blocks[once], contexts[once]


def _encoded(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _described(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _encoded(batch.column("text"))
            shas = [hashlib.sha256(row).digest() for row in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(row) for row in rows], pa.int64()),
                 pa.array([text_digest(sha) for sha in shas], pa.int64()), pa.array([sha.hex() for sha in shas])],
                ["doc_id", "n_bytes", "digest", "sha256"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, digest long, sha256 string")


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    seen = set()  # 8 bytes and a little for each text of a task
    for batch in batches:
        for row in _encoded(batch.column("text")):
            if len(row) >= LENGTH:
                name = text_digest(hashlib.sha256(row).digest())
                if name not in seen:
                    seen.add(name)
                    yield name, np.frombuffer(row, np.uint8)


def _marks(docs: DataFrame) -> DataFrame:
    """block, context, text and offset of every marked block."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        offsets, blocks, contexts = (np.concatenate([row[k] for row in rows]) for k in (1, 2, 3))
        texts = np.repeat(np.array([row[0] for row in rows], np.int64), [len(row[1]) for row in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks), pa.array(contexts), pa.array(texts), pa.array(offsets), pa.array(place(texts, offsets))],
            ["block", "context", "digest", "offset", "place"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name, data in _distinct_texts(batches):
            rows.append((name, *marked_blocks(data)))
            size += len(rows[-1][1])
            if size > 100_000:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    return docs.mapInArrow(run, "block long, context long, digest long, offset long, place long")


# --- a shard ---------------------------------------------------------------------------


def suffix_order(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and rank of all suffixes of the strings in ``data``, each up to the end of its
    string. Equal ones stay in the order of their strings. ``ends``: end of each byte's string."""
    n = len(data)
    at = np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    for k in range(7):  # seven bytes of nine bits; a string's end sorts first
        inside = at + k < ends
        key = (key << np.uint64(9)) | np.where(inside, padded[k : n + k], np.uint64(0))
    order = np.argsort(key)
    sorted_ = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, at, 0))
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    left, length, longest = ends - at, 7, int((ends - at).max(initial=0))
    while length < longest and len(tied):
        # Only groups of suffixes that are still equal are refined.
        suffix = order[tied]
        after = suffix + length
        following = np.where(left[suffix] > length, rank[np.minimum(after, n - 1)] + 1, 0)
        both = (rank[suffix] << 31) | following
        sort = np.argsort(both)
        suffix, both = suffix[sort], both[sort]
        order[tied] = suffix
        new = np.ones(len(tied), bool)
        new[1:] = both[1:] != both[:-1]
        rank[suffix] = tied[np.maximum.accumulate(np.where(new, at[: len(tied)], 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        length *= 2
    suffix = order[tied]
    order[tied] = suffix[np.argsort((rank[suffix] << 31) | suffix)]
    return order, rank


def common_prefixes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, least: int = LENGTH
) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to LENGTH; 0 for
    suffixes of fewer than ``least`` bytes, which are not asked for.

    Kasai's method: the suffix one byte on shares one byte less at least. All strings
    take the step at the same time. ``starts`` and ``ends`` are those of the strings."""
    n = len(data)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    end_of = np.repeat(ends, ends - starts)
    out = np.zeros(n, np.int64)
    shared = np.zeros(len(starts), np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : n + k].astype(np.uint64) << np.uint64(8 * k)
    for step in range(int((ends - starts).max(initial=0))):
        live = np.flatnonzero(starts + step + max(least, 1) <= ends)
        if not len(live):
            break
        i = starts[live] + step
        spot = place_of[i]
        j = order[np.maximum(spot - 1, 0)]
        h = np.maximum(shared[live] - 1, 0)
        most = np.where(spot > 0, np.minimum(np.minimum(end_of[i] - i, end_of[j] - j), LENGTH), 0)
        h = np.minimum(h, most)
        open_ = np.flatnonzero(h < most)
        while len(open_):
            a, b = i[open_] + h[open_], j[open_] + h[open_]
            differ = words[a] ^ words[b]
            low = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
            h[open_] = np.minimum(h[open_] + equal, most[open_])
            open_ = open_[(equal == 8) & (h[open_] < most[open_])]
        shared[live] = h
        out[spot] = h
    return out


def _flagged(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """For all strings of LENGTH bytes in the contexts of a shard: context, start in it,
    place, group of equal strings, and whether it starts at different places."""
    pieces = rows.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(x) for x in pieces])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    order, _ = suffix_order(data, np.repeat(ends, lengths))
    prefix = common_prefixes(data, starts, ends, order)
    group = np.cumsum(prefix < LENGTH) - 1
    owner = np.repeat(np.arange(len(pieces)), lengths)[order]
    start = order - starts[owner]
    whole = start + LENGTH <= lengths[owner]
    owner, start, group, order = owner[whole], start[whole], group[whole], order[whole]
    texts, offsets = (rows.column(c).to_numpy() for c in ("digest", "start"))
    spot = place(texts[owner], offsets[owner] + start)
    firsts = np.flatnonzero(np.diff(group, prepend=-1))
    many = rows.column("many").to_numpy()[owner]
    if not len(firsts):
        return owner, start, spot, group, np.zeros(0, bool), data, order
    sizes = np.diff(firsts, append=len(group))
    twice = (np.minimum.reduceat(spot, firsts) != np.maximum.reduceat(spot, firsts)) | np.logical_or.reduceat(many, firsts)
    return owner, start, spot, group, np.repeat(twice, sizes), data, order


def _shard(rows: pa.Table) -> pa.Table:
    """Ranges of string starts that are repeated, per context; and for blocks spread over
    shards one string of each group, to be merged with those of other shards."""
    owner, start, spot, group, twice, data, order = _flagged(rows)
    blocks, contexts = (rows.column(c).to_numpy() for c in ("block", "context"))
    low = np.full(len(blocks), 1 << 30, np.int64)
    high = np.full(len(blocks), -1, np.int64)
    np.minimum.at(low, owner[twice], start[twice])
    np.maximum.at(high, owner[twice], start[twice])
    hit = np.flatnonzero(high >= 0)
    spread = rows.column("parts").to_numpy()[owner] > 1
    first = np.flatnonzero(np.diff(group, prepend=-1).astype(bool) & spread)
    hashes = Hashes(data).of(order[first], order[first] + LENGTH).view(np.int64) if len(data) <= PIECE else _string_hashes(data, order[first])
    return pa.table(
        {
            "block": np.concatenate([blocks[hit], blocks[owner[first]]]),
            "context": np.concatenate([contexts[hit], contexts[owner[first]]]),
            "low": np.concatenate([low[hit], start[first]]),
            "high": np.concatenate([high[hit], start[first]]),
            "string": pa.array(np.concatenate([np.zeros(len(hit), np.int64), hashes]), mask=np.arange(len(hit) + len(first)) < len(hit)),
            "place": np.concatenate([np.zeros(len(hit), np.int64), spot[first]]),
        },
        schema=FOUND,
    )


def _string_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(at), np.int64)
    for low in range(0, len(data), PIECE):
        part = np.flatnonzero((at >= low) & (at < low + PIECE))
        out[part] = Hashes(data[low : low + PIECE + LENGTH]).of(at[part] - low, at[part] - low + LENGTH).view(np.int64)
    return out


FOUND = pa.schema([(c, pa.int64()) for c in ("block", "context", "low", "high", "string", "place")])
FOUND_TYPE = ", ".join(f"{c} long" for c in FOUND.names)


def _merged(rows: pa.Table) -> pa.Table:
    """Strings of different shards that are equal, found by binary search in the sorted strings."""
    strings, spots = rows.column("string").to_numpy(), rows.column("place").to_numpy()
    order = np.lexsort((spots, strings))
    run, spot = strings[order], spots[order]
    low, high = np.searchsorted(run, run, "left"), np.searchsorted(run, run, "right") - 1
    return rows.take(pa.array(order[spot[low] != spot[high]]))


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted contexts, one place of each."""
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("offset", "block", "context", "many", "parts", "shard")).alias("places"))
    texts = _wanted_texts(docs, wanted).join(lists, "digest")
    names = ["digest", "start", "bytes", "block", "context", "many", "parts", "shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, digest = batch.column("bytes")[k].as_py(), batch.column("digest")[k].as_py()
                places = batch.column("places")[k].values
                offsets = places.field("offset").to_numpy()
                starts = np.maximum(offsets - (LENGTH - BLOCK), 0)
                cut = [text[a : b + LENGTH] for a, b in zip(starts.tolist(), offsets.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cut), digest)), pa.array(starts), pa.array(cut, pa.binary()), *(places.field(c) for c in names[3:])], names
                )

    return texts.mapInArrow(run, "digest long, start long, bytes binary, block long, context long, many boolean, parts long, shard long")


def _wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """digest and bytes of the texts whose digest is wanted, and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("digest").distinct(), "digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            found = [x for x in _distinct_texts(iter([batch]))]
            if found:
                keep = passing(bits, np.array([name for name, _ in found], np.int64))
                found = [x for x, good in zip(found, keep.tolist(), strict=True) if good]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name for name, _ in found], pa.int64()), pa.array([data.tobytes() for _, data in found], pa.binary())], ["digest", "bytes"]
                )

    return docs.mapInArrow(run, "digest long, bytes binary")


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    """(removed bytes, maximal runs, digest of what is left) for the ranges ``spans``."""
    removed = runs = at = 0
    left = hashlib.sha256()
    for low, high in sorted(spans):
        if low > at or not runs:
            left.update(text[at:low])
            runs += 1
            removed += high - low
        elif high > at:
            removed += high - at
        at = max(at, high)
    left.update(text[at:])
    return removed, runs, left.hexdigest()


def repeated_ranges(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Digests of all rows (doc_id, n_bytes, digest, sha256), and per digest of a text its removed ranges."""
    docs = keyed_texts(df, key, text)
    own = materialize(_described(docs), "described")
    rows = _marks(docs).filter("block IS NOT NULL").repartition("block")
    rest = ("context", "digest", "offset")
    twice = rows.groupBy("block").agg(F.min("place").alias("low"), F.max("place").alias("high"), *(F.min(c).alias(c) for c in rest))
    # As many columns as the join reads, so that both read one shuffle.
    twice = twice.filter("low <> high AND isnotnull(least(context, digest, offset))").select("block")
    marks = materialize(rows.join(twice, "block"), "marks")

    each = marks.groupBy("block", "context").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.min(F.struct("digest", "offset")).alias("one")
    )
    each = materialize(each.select("block", "context", (F.col("low") != F.col("high")).alias("many"), "one.digest", "one.offset"), "contexts")
    kinds = each.groupBy("block").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    total = kinds.agg(F.sum("kinds")).first()[0] or 0
    parts = F.ceil(F.col("kinds") / BLOCK_CONTEXTS)
    piece = F.when(parts > 1, F.pmod(F.xxhash64("context"), parts)).otherwise(F.lit(0))
    shards = max(1, -(-int(total) // SHARD_CONTEXTS))
    wanted = each.join(kinds, "block").withColumn("parts", parts)
    wanted = wanted.withColumn("shard", F.pmod(F.xxhash64("block", piece), F.lit(shards)))
    wanted = materialize(wanted.drop("kinds"), "wanted")
    found = materialize(_contexts(docs, wanted).groupBy("shard").applyInArrow(_shard, FOUND_TYPE), "found")
    across = found.filter("string IS NOT NULL").groupBy(F.pmod(F.xxhash64("string"), F.lit(4 * shards))).applyInArrow(_merged, FOUND_TYPE)
    ranges = found.filter("string IS NULL").unionAll(across).groupBy("block", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    last = F.least("offset", F.lit(LENGTH - BLOCK)).cast("long")  # strings start no later than the block
    full = each.filter("many").select("block", "context", F.lit(0).cast("long").alias("low"), last.alias("high"))
    ranges = ranges.unionAll(full).groupBy("block", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    start = F.greatest(F.col("offset") - (LENGTH - BLOCK), F.lit(0))
    spans = marks.join(ranges, ["block", "context"]).select(
        "digest", (start + F.col("low")).alias("low"), (start + F.col("high") + LENGTH).alias("high")
    )
    # A text's ranges, bounded by its own length.
    return own, spans.distinct().groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""
    own, spans = repeated_ranges(df, key, text)
    spans = materialize(spans, "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, listed in zip(batch.column("bytes").to_pylist(), batch.column("spans"), strict=True):
                values = listed.values
                low, high = (values.field(c).to_numpy() for c in ("low", "high"))
                found.append(_kept(data, list(zip(low.tolist(), np.minimum(high, len(data)).tolist(), strict=True))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["digest", "removed", "runs", "left"],
            )

    texts = _wanted_texts(keyed_texts(df, key, text), spans).join(spans, "digest")
    cut = texts.mapInArrow(run, "digest long, removed long, runs long, left string").dropDuplicates(["digest"])
    copies = own.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    return (
        own.join(copies, "digest")
        .join(cut, "digest", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(whole, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "sha256")).alias("kept_sha256"),
        )
    )
