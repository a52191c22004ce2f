"""Near duplicates: Jaccard join of word shingles with adaptive multi-match prefixes.

Texts with equal shingle sets form a class. A class orders its shingles from rare to
common and puts a prefix of them forward: two sets of similarity 0.8 share at least l
shingles of prefixes that are l - 1 longer than the shortest sufficient ones. Each
class chooses its l where the estimated cost of candidates and their verification is
least; a pair has to share the smaller l of the two. Rarity comes from counts of all
texts' shingles in 2**SKETCH_BITS cells (a fixed size; it only orders and estimates).

Large groups are not paired out. First every class is verified against one of the
most central classes that its prefix shingles lead to; only shingles that then still
connect different components matter further, and of their rows those that by sizes and places in the
prefixes may be the first shingle that a similar pair shares. There the classes outside the largest component
meet the others in cells of bounded size (``open_buckets``), which bring their
parity bits, a 64th of a set's size or up to twice that: these rule out pairs that differ too much before any row
is made of a pair. What is left has to share as many prefix shingles as the smaller l, and is
verified. So nothing is lost, and a group of n similar texts costs about n verifications.

Defined results: null, empty and blank texts have no shingles and link with nothing;
repeated rows and equal sets link; a null key gives a null component. Shingles and
sets are told apart by 64-bit hashes. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from patronage.llm.common import keyed_texts, small_batches, tidy
from patronage.llm.components import components
from patronage.llm.id_filter import id_filter, passing
from patronage.llm.open_buckets import groups_of, open_rows, sorted_groups, together
from patronage.llm.parities import Parities, parity_bits
from patronage.llm.shingles import batch_sets, set_digest
from patronage.session import materialize

SKETCH_BITS = 20
SKETCH_CHUNKS = 64
#: Longest extension of a prefix, and cost of comparing one shingle relative to one match.
LEVELS = 4
VERIFY_COST = 0.05
#: Pairs of two numbers that are sent to all executors at most, 24 MB.
BROADCAST_PAIRS = 1_000_000
#: Least logarithm of the parity bits of a set.
LEAST_CELLS = 9
#: Rows of a bucket that are compared with each other before any brings parity bits.
SMALL_BUCKET = 64


def needed(n):
    """Least overlap of a set of ``n`` with any set of similarity 0.8 or more."""
    return (4 * n + 4) // 5


def _described(docs: DataFrame) -> DataFrame:
    """A row per document with its set's size and digest, and each task's counts of shingles in chunks."""
    cells, per_chunk = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        names = ["doc_id", "n", "class", "chunk", "counts"]
        for part, sets in batch_sets(batches, "text"):
            classes = [set_digest(x) for x in sets]
            if any(map(len, sets)):
                cell = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                counts += np.bincount(cell.astype(np.int64), minlength=cells).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(classes, pa.int64()),
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        pack = zstandard.ZstdCompressor(level=1).compress
        blobs = [pack(counts[i : i + per_chunk].tobytes()) for i in range(0, cells, per_chunk)]
        nothing = pa.nulls(SKETCH_CHUNKS, pa.int64())
        ids = pa.nulls(SKETCH_CHUNKS, id_type)
        yield pa.RecordBatch.from_arrays([ids, nothing, nothing, pa.array(range(SKETCH_CHUNKS), pa.int32()), pa.array(blobs, pa.binary())], names)

    kind = docs.schema["doc_id"].dataType
    id_type = pa.string() if kind.simpleString() == "string" else pa.int32() if kind.simpleString() == "int" else pa.int64()
    return docs.mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, n long, class long, chunk int, counts binary")


def _sketch(described: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts: 2**SKETCH_BITS numbers, whatever the input."""
    size = (1 << SKETCH_BITS) // SKETCH_CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, sums = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, np.zeros(size, np.float64)) + np.frombuffer(unpack(blob), np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    chunks = described.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk", F.spark_partition_id() % 8)
    once = chunks.mapInArrow(tidy(run), "chunk int, counts binary").collect()
    out = np.zeros((SKETCH_CHUNKS, size), np.float32)
    for row in once:
        out[row.chunk] += np.frombuffer(row.counts, np.float32)
    return out.ravel()


def _prefix(tokens: np.ndarray, counts: np.ndarray, load: float) -> tuple[np.ndarray, int, int]:
    """Prefix tokens from rare to common, the chosen l, and the set's centrality."""
    excess = np.maximum(counts - (load + 3 * np.sqrt(load)), 0.0)
    order = np.lexsort((tokens, excess))
    n, enough = len(tokens), needed(len(tokens))
    levels = np.arange(1, min(LEVELS, enough) + 1)
    matches = np.cumsum(excess[order])[n - enough + levels - 1]
    cost = matches + VERIFY_COST * n * matches / levels + levels  # each candidate takes l matches
    level = int(levels[np.argmin(cost)])
    return tokens[order[: n - enough + level]], level, int(1000 * np.log1p(counts).mean())


def _prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """A row per prefix shingle of each class that a task meets; ``pos`` counts from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        load = float(counts.mean())
        for _, sets in batch_sets(batches, "text"):
            rows = []
            for tokens in sets:
                name = (set_digest(tokens), len(tokens))
                if not len(tokens) or name in seen:
                    continue
                seen.add(name)  # 16 bytes and a little for each text of the task
                chosen, _, centre = _prefix(tokens, counts[tokens >> np.uint64(64 - SKETCH_BITS)], load)
                rows.append((chosen.view(np.int64), np.arange(len(chosen), dtype=np.int32), *name, centre))
            if rows:
                sizes = np.array([len(row[0]) for row in rows])
                own = [np.repeat(np.array([row[k] for row in rows]), sizes) for k in range(2, 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([row[0] for row in rows])), pa.array(np.concatenate([row[1] for row in rows])),
                     pa.array(own[0]), pa.array(own[1].astype(np.int32)), pa.array(own[2].astype(np.int32))],
                    ["token", "pos", "class", "n", "centre"])

    return docs.mapInArrow(tidy(run), "token long, pos int, class long, n int, centre int")


def _set_rows(docs: DataFrame, wanted: DataFrame, made: Callable[[list[np.ndarray]], dict[str, pa.Array]], fields: str) -> DataFrame:
    """``rep`` and the columns that ``made`` gives for the sets of the wanted representatives
    (and of the few others that the filter lets pass).

    What is wanted of a set is made where the set is made: a second Python step in the
    same stage would double the Python workers that an executor keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passing(bits, batch.column("hash").to_numpy())))

        for part, sets in batch_sets(chosen(), "text"):
            columns = made(sets)
            yield pa.RecordBatch.from_arrays([part.column("rep"), *columns.values()], ["rep", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.dropna(subset=["doc_id"]).select(F.col("doc_id").alias("rep"), F.xxhash64("doc_id").alias("hash"), "text")
    return texts.mapInArrow(tidy(run), f"rep {kind}, {fields}")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets of the wanted representatives."""
    return _set_rows(docs, wanted, lambda sets: {"tokens": pa.array([x.tobytes() for x in sets], pa.binary())}, "tokens binary")


def _summaries(docs: DataFrame, wanted: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Of the wanted representatives' sets: size, parity bits (a bit for each cell that an odd
    number of shingles falls into, with one or two cells per shingle), prefix, and level."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 4 MB

    def made(sets: list[np.ndarray]) -> dict[str, pa.Array]:
        counts = shared.value
        load = float(counts.mean())
        chosen = [_prefix(x, counts[x >> np.uint64(64 - SKETCH_BITS)], load) if len(x) else (x, 1, 0) for x in sets]
        return {
            "size": pa.array([len(x) for x in sets], pa.int64()),
            "bits": pa.array([folded(parity_bits(x)) for x in sets], pa.binary()),
            "prefix": pa.array([prefix.tobytes() for prefix, _, _ in chosen], pa.binary()),
            "level": pa.array([level for _, level, _ in chosen], pa.int64()),
        }

    return _set_rows(docs, wanted, made, "size long, bits binary, prefix binary, level long")


def folded(bits: bytes) -> bytes:
    """Parity bits in half as many cells, but not fewer than 2**LEAST_CELLS."""
    half = len(bits) // 2
    if 8 * half < 1 << LEAST_CELLS:
        return bits
    x = np.frombuffer(bits, np.uint8)
    return (x[:half] ^ x[half:]).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A number of shingles in which two sets differ at least, from their parity bits.

    A cell whose parity differs holds a shingle of one set only. Longer bits are folded."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _possible(pairs: DataFrame, parities: DataFrame) -> DataFrame:
    """The pairs that their parity bits don't rule out."""
    sides = [parities.select("rep", "size", "bits").toDF(c, f"size_{c}", f"bits_{c}") for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("size_a", "size_b", "bits_a", "bits_b"))
            for n, m, x, y in zip(*columns, strict=True):
                # Similar sets share 4 / 9 of their sizes' sum or more.
                keep.append(least_difference(x, y) <= n + m - 2 * -(-4 * (n + m) // 9))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(tidy(run), f"a {pairs.schema['a'].dataType.simpleString()}, b {pairs.schema['b'].dataType.simpleString()}").distinct()


def _shared_enough(pairs: DataFrame, summaries: DataFrame) -> DataFrame:
    """The pairs whose prefixes, cut to the smaller level, share as many shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("prefix_a", "level_a", "prefix_b", "level_b"))
            for x, level_x, y, level_y in zip(*columns, strict=True):
                x, y, level = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), min(level_x, level_y)
                keep.append(len(np.intersect1d(x[: len(x) - level_x + level], y[: len(y) - level_y + level])) >= level)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Few nodes are left in pairs; prefixes of others need not move.
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    prefixes = summaries.select("rep", "prefix", "level").join(wanted, "rep", "left_semi")
    sides = [prefixes.toDF(c, f"prefix_{c}", f"level_{c}") for c in "ab"]
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def _may_be_first(rows: DataFrame) -> DataFrame:
    """Open rows without those whose shingle is not the first that their set shares with a similar one.

    From its first shared shingle on, a set holds all that the two share, 4 / 9 of their sizes' sum or
    more: ``rest`` shingles, that one included. So a row needs a row of another component for which
    both rests suffice; a similar pair has such rows at its first shared shingle. Rows are
    compared where a bucket has up to SMALL_BUCKET; those of larger ones all stay."""
    large = F.col("bucket") > SMALL_BUCKET
    part = F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("bucket") / SMALL_BUCKET))).otherwise(0)
    listed = rows.groupBy("key", "largest", "n_x", "n_y", "bucket", part.alias("part")).agg(
        F.collect_list(F.struct("node", "component", "n", "rest")).alias("rows")
    )

    def meets(x, y):
        return (x["component"] != y["component"]) & (F.least(x["rest"], y["rest"]) * 9 >= (x["n"] + y["n"]) * 4)

    near = F.filter("rows", lambda x: F.exists("rows", lambda y: meets(x, y)))
    kept = listed.select("key", "largest", "n_x", "n_y", F.inline(F.when(large, F.col("rows")).otherwise(near)))
    return kept.select("key", "node", "component", "largest", "n_x", "n_y")


def _cross_pairs(groups: DataFrame, summaries: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that meet in a group and may be similar."""

    def met(rows: pa.Table, bounds: list[tuple[int, int]]) -> Iterator[tuple]:
        outside, size = (rows.column(c).to_numpy() for c in ("outside", "size"))
        nodes, component = (rows.column(c).to_pylist() for c in ("node", "component"))
        number = {name: k for k, name in enumerate(dict.fromkeys(component))}
        component = np.array([number[name] for name in component], np.int64)
        parities = Parities(size, rows.column("bits").combine_chunks())
        for start, end in bounds:
            own = np.arange(start, end)
            others = own[~outside[start:end]]
            for i in own[outside[start:end]].tolist():
                fits = 5 * np.minimum(size[others], size[i]) >= 4 * np.maximum(size[others], size[i])
                near = others[(component[others] != component[i]) & fits]
                for k in near[parities.may_link(i, near)].tolist():
                    yield min(nodes[i], nodes[k]), max(nodes[i], nodes[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in sorted_groups(batches):
            found = sorted(set(met(rows, bounds)))
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(column), id_type) for column in columns], ["a", "b"])

    kind = groups.schema["node"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    rows = together(groups.join(summaries.select(F.col("rep").alias("node"), "size", "bits"), "node"))
    return rows.mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the stored pairs (a, b) of representatives whose sets are similar.

    The set of a travels to that of b, so b should be what many pairs have in common.
    Few pairs are sent to where the sets of their a are made; more than
    BROADCAST_PAIRS meet them by a shuffle. A key that several rows share may stand
    for several sets; any two are compared."""
    few = pairs.count() <= BROADCAST_PAIRS
    sides = [
        _sets(docs, pairs.select(F.col(c).alias("rep")).distinct()).withColumnsRenamed({"rep": c, "tokens": name})
        for c, name in (("a", "x"), ("b", "y"))
    ]
    joined = sides[0].join(F.broadcast(pairs) if few else pairs, "a").join(sides[1], "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(tidy(run), f"a {kind}, b {kind}")


def _sizes_fit(n: str, m: str):
    return (F.least(n, m) * 5) >= (F.greatest(n, m) * 4)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) for every row."""
    with small_batches(df.sparkSession):  # all Python steps run here; what is returned only joins their tables
        return _near_duplicates(keyed_texts(df, key, text))


def _near_duplicates(docs: DataFrame) -> DataFrame:
    described = materialize(_described(docs), "described")
    own = described.filter("chunk IS NULL").select("doc_id", "n", "class")
    classes = own.filter("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")

    # Both sides of the join need the same columns and rows, so the shuffle is done once.
    sketch = _sketch(described)
    rows = _prefixes(docs, sketch).filter("token IS NOT NULL AND class IS NOT NULL AND n IS NOT NULL")
    rows = rows.repartition("token")
    rest = ("n", "pos", "centre")
    shared = rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high"), *(F.min(c).alias(c) for c in rest))
    shared = shared.filter("low <> high AND least(n, pos, centre) >= 0").select("token")
    matched = rows.join(shared, "token").distinct().join(classes.dropna(subset=["rep"]), ["class", "n"])
    matched = materialize(matched.drop("class"), "matched")

    leaders = matched.groupBy("token").agg(F.max(F.struct("centre", "rep", "n")).alias("lead"))
    stars = (
        matched.join(leaders, "token")
        .filter("rep <> lead.rep")
        .filter(_sizes_fit("n", "lead.n"))
        .groupBy(F.col("rep").alias("a"), F.col("lead.rep").alias("b"))
        .agg(F.count(F.lit(1)).alias("shared"))
        .groupBy("a")
        .agg(F.max(F.struct("shared", "b")).alias("best"))
        .select("a", "best.b")
    )
    stars = materialize(stars, "stars")
    summaries = materialize(_summaries(docs, matched.select("rep").distinct(), sketch), "summaries")
    links = materialize(_verified(materialize(_possible(stars, summaries), "possible"), docs), "links")
    first = components(links)

    left = matched.select(F.col("token").alias("key"), F.col("rep").alias("node"), "n", (F.col("n") - F.col("pos")).alias("rest"))
    groups = groups_of(materialize(_may_be_first(open_rows(left, first, sized=True)), "open"))
    pairs = (
        _shared_enough(materialize(_cross_pairs(groups, summaries), "met"), summaries)
        .join(stars, ["a", "b"], "left_anti")
        .join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    )
    more = materialize(_verified(materialize(pairs, "pairs"), docs), "links")
    if more.head(1):
        first = components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    ids = classes.join(first.withColumnRenamed("id", "rep"), "rep", "left")
    ids = ids.select("class", "n", F.coalesce("component", "rep").alias("component"))
    return own.join(ids, ["class", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
    )


def keep_one(df: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id; rows without a key stay.

    Rows are judged, not keys: rows of one key with different texts are documents of their
    own, of which similar ones keep the smallest row hash. Rows equal in key and text are one
    document and leave one row, the one whose other columns hash lowest."""
    docs = df.filter("doc_id IS NOT NULL")
    digest = F.xxhash64("doc_id", "text")
    texts = docs.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    # Keys compress better than hashes and name the row too, as long as no key has several texts.
    several = bool(texts.filter("low <> high").head(1))
    docs = docs.withColumn("__row", digest if several else F.col("doc_id"))
    found = near_duplicates(docs, key="__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    if several:
        named = found.join(docs.select("__row", "doc_id").distinct(), "__row")
        chosen = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first")).select("first.__row")
    else:
        chosen = found.filter("__row = component_id").select("__row")
    kept = docs.join(chosen, "__row")
    # The join has sorted by row, so this drops repeated rows as they pass by.
    rest = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, MapType)))
    turn = F.row_number().over(Window.partitionBy("__row").orderBy(rest))
    kept = kept.withColumn("__turn", turn).filter("__turn = 1")
    return kept.select(*(f"`{c}`" for c in df.columns)).unionByName(df.filter("doc_id IS NULL"))
