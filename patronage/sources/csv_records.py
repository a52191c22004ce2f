"""Records of CSV files whose quoted fields may span lines, without giving up on splitting files.

A line with an odd number of quotes opens or closes such a field. Two sums tell of every
line which: over the blocks of a file (one row per block), and over the lines of a block, which
one task has read anyway. Only the lines of blocks with an odd line move, to be counted in their
order, and then the lines of records that have several are put together. Everything else goes
straight from the scan to the parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronage.session import materialize

#: Blocks (of 128 MB as a rule, a row of 40 bytes each) that are sent to all executors at most.
SENT_BLOCKS = 1_000_000

_QUOTED = '"[^"]*+(?:""[^"]*+)*+"[^,\\n]*+'
_FIELD = f'(?:{_QUOTED}|[^",\\n][^,\\n]*+)?+'
#: A record in which only quoted fields hold line ends.
_WHOLE = f"\\A{_FIELD}(?:,{_FIELD})*+\\z"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where it starts), at (ascending within a block), value and odd (number of quotes modulo 2)."""
    lines = spark.read.option("lineSep", "\n").text(path)
    value = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        value.alias("value"),
        (quotes % 2).cast("bigint").alias("odd"),
    )


def block_sums(lines: DataFrame) -> DataFrame:
    """file, block, n_odd (its odd lines) and first (its first line that is not blank).

    Numbers only: for an aggregate of text Spark would sort all lines instead of hashing a row per block."""
    filled = F.when(F.trim("value") != "", F.col("at"))
    return lines.groupBy("file", "block").agg(F.sum("odd").alias("n_odd"), F.min(filled).alias("first"))


def quote_blocks(lines: DataFrame) -> DataFrame:
    """A stored row per block: its odd lines, those before it in the file, and the file's header line.

    A file with an odd number of odd lines raises: one of its quoted fields has no end."""
    found = block_sums(lines)
    of_file = Window.partitionBy("file")
    earlier = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    header = F.min(F.when(F.col("first").isNotNull(), F.struct("block", "first"))).over(of_file)
    blocks = found.select(
        "file",
        "block",
        "n_odd",
        F.coalesce(F.sum("n_odd").over(earlier), F.lit(0)).alias("before"),
        header["first"].alias("header"),
    )
    blocks = materialize(blocks, "csv-blocks")
    open_ = blocks.groupBy("file").agg(F.sum("n_odd").alias("n")).where("n % 2 = 1").head(1)
    if open_:
        path = lines.where(F.col("file") == open_[0]["file"]).select("path").first()["path"]
        raise ValueError(f"MALFORMED_RECORD: {path} ends within a quoted field")
    return blocks


def records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(record): the text of every record but the headers and blank lines.

    ``blocks`` is what ``quote_blocks`` gave for the same ``lines``."""
    few = blocks.count() <= SENT_BLOCKS
    rows = lines.drop("path").join(F.broadcast(blocks) if few else blocks, ["file", "block"])
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.where("n_odd > 0").withColumn("upto", F.col("before") + F.coalesce(F.sum("odd").over(earlier), F.lit(0)))
    rows = rows.where("n_odd = 0").withColumn("upto", F.col("before")).unionByName(counted)

    single = (F.col("upto") % 2 == 0) & (F.col("odd") == 0)
    alone = rows.where(single & (F.trim("value") != "") & (F.col("at") != F.col("header"))).select(F.col("value").alias("record"))
    pieces = (
        rows.where(~single)
        .groupBy("file", F.floor(F.col("upto") / 2).alias("number"))
        .agg(
            F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines"),  # of one record
            F.max(F.col("at") == F.col("header")).alias("is_header"),
        )
        .where("NOT is_header")
        .select(F.array_join("lines.value", "\n").alias("record"))
    )
    wrong = F.concat(F.lit("MALFORMED_RECORD: a quote within an unquoted field: "), F.left("record", F.lit(200)))
    whole = F.when(F.col("record").rlike(_WHOLE), F.col("record")).otherwise(F.raise_error(wrong))
    return alone.unionByName(pieces.select(whole.alias("record")))
