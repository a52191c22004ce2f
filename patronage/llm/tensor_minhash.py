"""Near duplicates: MinHash over two-word shingles with tensored banding.

Two small collections of ``SIDE`` blocks, each of ``BLOCK`` minhashes, give a table for
every pair of a left and a right block: SIDE * SIDE tables of 2 * BLOCK hashes each from
2 * SIDE * BLOCK minhashes, where tables of their own would take SIDE times as many. A pair
meets in a table if it agrees in one block of each side; at similarity s it is missed with
probability 2 * (1 - s**BLOCK)**SIDE at most, 7e-5 at 0.8 and 1e-7 at 0.9.

Texts with equal shingle sets are one node. A node's keys are only formed of blocks that it
shares with other nodes. Buckets (table, key) are not paired out:

1. Every node is compared with one leader, that of its buckets' leaders (least digest) which
   it shares most buckets with. Links that hold are joined to components.
2. Only buckets that then still hold several components matter. There the nodes outside the
   bucket's largest component meet the others, in cells of about ``open_buckets.CELL`` nodes a side. A
   pair counts in the first table that it shares. First each node proposes its likeliest
   partner (``PROPOSALS`` times), and links that hold join components; then all pairs do.

So a group of n similar texts costs about n comparisons of whole sets; nothing is capped or
left out. Nodes that share a bucket without linking are compared in their cells by
minhashes; rows are made in proportion to their number times a CELLth of the bucket.

Candidates whose minhashes agree in fewer than ``LEAST_EQUAL`` places (at similarity 0.8
with probability 1e-6), or whose parity bits prove too many different shingles, go no
further; all others are confirmed on their whole sets.

Defined results: null, empty and blank texts have no shingles and link with nothing; repeated
rows and equal sets link; a null key gives a null component and a null ``kept``; a
key that several rows share stands for each of their texts; an empty table gives no rows.
Shingles and sets are told apart by 64-bit hashes. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import keyed_texts, mix64, slices, tidy
from patronage.llm.components import components
from patronage.llm.id_filter import id_filter, passing
from patronage.llm.open_buckets import groups_of, open_rows, sorted_groups, together
from patronage.llm.parities import Parities, parity_bits
from patronage.llm.shingles import RUN_BYTES, set_digest, word_hashes
from patronage.session import materialize

SHINGLE_WORDS = 2
SIDE = 10
BLOCK = 2
HASHES = 2 * SIDE * BLOCK
LEAST_EQUAL = 19
PROPOSALS = 1
#: The low bits of a key tell its table.
_TABLE = 127
#: The low bits of a block's hash tell its side and place.
_PLACE = 31

_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:HASHES], _SEEDS[HASHES:] | np.uint64(1)
_FIRST, _SECOND = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def shingle_sets(words: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word pairs; a single word is one by itself."""
    pairs = mix64(words[:-1] * _FIRST + words[1:] * _SECOND + np.uint64(SHINGLE_WORDS)) if len(words) else words
    start = 0
    for end in ends.tolist():
        if end - start == 1:
            yield mix64(words[start:end] * _FIRST + np.uint64(1))
        else:
            yield np.unique(pairs[start : max(start, end - 1)])
        start = end


def batch_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text", RUN_BYTES):
            yield part, list(shingle_sets(*word_hashes(part.column("text"))))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """set, hash: the least 32-bit hash of each non-empty set under each function."""
    out = np.empty((len(sets), HASHES), np.uint32)
    tokens = np.concatenate(sets) if sets else np.array([], np.uint64)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    for k in range(HASHES if len(sets) else 0):
        mixed = (tokens ^ _XOR[k]) * _ODD[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _FIRST
        out[:, k] = np.minimum.reduceat((mixed >> np.uint64(32)).astype(np.uint32), starts)
    return out


def block_hashes(hashes: np.ndarray) -> np.ndarray:
    """set, side, block: hashes of the blocks, whose low bits tell their place."""
    blocks = hashes.reshape(len(hashes), 2, SIDE, BLOCK).astype(np.uint64)
    one = np.zeros(blocks.shape[:3], np.uint64)
    for k in range(BLOCK):
        one = mix64(one * _SECOND + blocks[..., k] + np.uint64(1))
    return (one & ~np.uint64(_PLACE)) | np.arange(2 * SIDE, dtype=np.uint64).reshape(2, SIDE)


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """set, table: keys formed of every left and every right block."""
    one = block_hashes(hashes)
    keys = mix64(mix64(one[:, 0, :, None]) * _SECOND + mix64(one[:, 1, None, :])).reshape(len(hashes), SIDE * SIDE)
    return ((keys & ~np.uint64(_TABLE)) | np.arange(SIDE * SIDE, dtype=np.uint64)).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (the set's digest), sketch (minhashes) and parity bits; these are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in batch_sets(batches):
            full = [k for k, tokens in enumerate(sets) if len(tokens)]
            sketches: list[bytes | None] = [None] * len(sets)
            for k, row in zip(full, minhashes([sets[k] for k in full]), strict=True):
                sketches[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_digest(x) for x in sets], pa.int64()),
                 pa.array(sketches, pa.binary()), pa.array([parity_bits(x) if len(x) else None for x in sets], pa.binary())],
                ["doc_id", "n", "node", "sketch", "bits"],
            )

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long, sketch binary, bits binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def in_shared_blocks(nodes: DataFrame) -> DataFrame:
    """(node, sketch, shared) of nodes that share a left and a right block with others.

    Bit k of ``shared`` stands for block k. Only tables of two shared blocks can be shared,
    so the few block hashes of a node rule most of its many table keys out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = block_hashes(_matrix(batch.column("sketch"))).reshape(batch.num_rows, 2 * SIDE).view(np.int64)
            own = np.repeat(batch.column("node").to_numpy(), 2 * SIDE)
            yield pa.RecordBatch.from_arrays([pa.array(blocks.ravel()), pa.array(own)], ["block", "node"])

    blocks = nodes.select("node", "sketch").mapInArrow(tidy(run), "block long, node long")
    shared = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("block")
    bit = F.expr(f"shiftleft(1L, CAST(block & {_PLACE} AS INT))")
    found = blocks.join(shared, "block").groupBy("node").agg(F.bit_or(bit).alias("shared"))
    side = (1 << SIDE) - 1
    found = found.filter((F.col("shared").bitwiseAND(side) != 0) & (F.col("shared").bitwiseAND(side << SIDE) != 0))
    return nodes.select("node", "sketch").join(found, "node")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(key, node) of every table that two shared blocks form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = table_keys(_matrix(batch.column("sketch")))
            bits = (batch.column("shared").to_numpy()[:, None] >> np.arange(2 * SIDE)) & 1 == 1
            both = (bits[:, :SIDE, None] & bits[:, None, SIDE:]).reshape(keys.shape)
            own = np.broadcast_to(batch.column("node").to_numpy()[:, None], keys.shape)
            yield pa.RecordBatch.from_arrays([pa.array(keys[both]), pa.array(own[both])], ["key", "node"])

    return nodes.select("node", "sketch", "shared").mapInArrow(tidy(run), "key long, node long")


def _sizes_fit(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= 80 * np.maximum(n, m)


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes, minhashes and parity bits don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            keep = _sizes_fit(n_a, n_b)
            keep &= (_matrix(batch.column("sketch_a")) == _matrix(batch.column("sketch_b"))).sum(axis=1) >= LEAST_EQUAL
            both = Parities(np.concatenate([n_a, n_b]), pa.concat_arrays([batch.column("bits_a"), batch.column("bits_b")]))
            for k in np.flatnonzero(keep).tolist():
                keep[k] = both.may_link(k, np.array([k + len(n_a)]))[0]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [nodes.select("node", "n", "sketch", "bits").toDF(c, f"n_{c}", f"sketch_{c}", f"bits_{c}") for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(tidy(run), "a long, b long")


def _node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the wanted (node, rep), and of the few others that the filter lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passing(bits, batch.column("hash").to_numpy())))

        for _, sets in batch_sets(chosen()):
            new = {node: tokens for tokens in sets if (node := set_digest(tokens)) not in seen}
            seen.update(new)  # a number for each text of the task
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([x.tobytes() for x in new.values()], pa.binary())], ["node", "tokens"])

    named = docs.dropna(subset=["doc_id"]).select(F.xxhash64("doc_id").alias("hash"), "text")
    return named.mapInArrow(tidy(run), "node long, tokens binary")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole sets are similar.

    The set of a travels to that of b, so b should be what many pairs have in common."""
    sides = []
    for c, name in (("a", "x"), ("b", "y")):
        wanted = pairs.select(F.col(c).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
        sides.append(_node_sets(docs, wanted).withColumnsRenamed({"node": c, "tokens": name}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _proposed(rows: pa.Table, bounds: list[tuple[int, int]], likeliest: bool) -> Iterator[tuple[int, int, int]]:
    """(node, partner, equal minhashes) of nodes of a group that differ in component and are
    not ruled out and meet in this table first: for each node outside its likeliest partner, or all."""
    outside = rows.column("outside").to_numpy()
    key, node, component, n = (rows.column(c).to_numpy() for c in ("key", "node", "component", "n"))
    hashes, parities = _matrix(rows.column("sketch").combine_chunks()), Parities(n, rows.column("bits").combine_chunks())
    blocks = hashes.view(np.uint64) if BLOCK == 2 else block_hashes(hashes).reshape(len(hashes), 2 * SIDE)
    for start, end in bounds:
        left, right = divmod(int(key[start]) & _TABLE, SIDE)
        before = [*range(left), *range(SIDE, SIDE + right)]  # blocks that would have brought a pair together earlier
        own = np.arange(start, end)
        others = own[~outside[start:end]]
        for i in own[outside[start:end]].tolist():
            near = others[(component[others] != component[i]) & _sizes_fit(n[others], n[i])]
            near = near[~(blocks[near][:, before] == blocks[i, before]).any(axis=1)]
            equal = (hashes[near] == hashes[i]).sum(axis=1)
            enough = equal >= LEAST_EQUAL
            near, equal = near[enough], equal[enough]
            may = parities.may_link(i, near)
            near, equal = near[may], equal[may]
            chosen = [int(equal.argmax())] if likeliest and len(near) else range(len(near))
            for k in chosen:
                yield int(node[i]), int(node[near[k]]), int(equal[k])


def cross_pairs(groups: DataFrame, nodes: DataFrame, likeliest: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different components that share an open bucket:
    each node's likeliest partner, or all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in sorted_groups(batches):
            found = list(_proposed(rows, bounds, likeliest))
            if found:
                columns = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], ["a", "b", "equal"])

    met = together(groups.join(nodes.select("node", "n", "sketch", "bits"), "node")).mapInArrow(tidy(run), "a long, b long, equal long")
    if likeliest:
        met = met.groupBy("a").agg(F.max(F.struct("equal", "b")).alias("best")).select("a", "best.b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after more links (a, b)."""
    return components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept for every row."""
    docs = keyed_texts(df, key, text)
    rows = materialize(described(docs), "described")
    nodes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node", "n").agg(*(F.min(c).alias(name) for c, name in (("doc_id", "rep"), ("sketch", "sketch"), ("bits", "bits"))))
    nodes = materialize(nodes, "nodes")

    buckets = bucket_rows(materialize(in_shared_blocks(nodes), "shared-blocks"))
    leaders = buckets.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    matched = materialize(buckets.join(leaders.select("key", "lead"), "key"), "matched")
    stars = (
        matched.filter("node <> lead")
        .groupBy(F.col("node").alias("a"), F.col("lead").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("a")
        .agg(F.max(F.struct("shared", "b")).alias("best"))
        .select("a", "best.b")
    )
    tried = materialize(plausible(stars, nodes), "stars")
    labels = components(materialize(confirmed(tried, nodes, docs), "links"))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    left = matched.select("key", "node")
    for turn in range(PROPOSALS + 1):
        open_ = materialize(open_rows(left, labels), "open")
        pairs = cross_pairs(groups_of(open_), nodes, likeliest=turn < PROPOSALS)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(confirmed(pairs, nodes, docs), "links")
        if links.head(1):
            labels = _joined(labels, links)
        left, tried = open_.select("key", "node"), tried.union(pairs)

    labels = nodes.select("node", "rep").join(labels.withColumnRenamed("id", "node"), "node", "left")
    labels = materialize(labels.select("node", "rep", F.coalesce("component", "node").alias("component")), "node-labels")
    least = labels.groupBy("component").agg(F.min("rep").alias("least"))
    ids = labels.join(least, "component").select("node", "least")
    found = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
