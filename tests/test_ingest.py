"""Typed CSV ingest: what is read, what is NULL and what is refused."""

import datetime
import random
import re
from decimal import Decimal

import pytest

from patronage.operators.quality import QualityError
from patronage.schemas import PRIMARY_KEYS, RAW_TABLES
from patronage.sources import csv_records
from patronage.sources import csv_tables as C
from patronage.sources.csv_records import numbered_lines, quote_blocks
from patronage.sources.parquet_tables import row_counts, write_table

SAMPLES = {
    "customers": "c1,u1,01037,sao paulo,SP",
    "orders": "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,,,2017-10-18 00:00:00",
    "order_items": "o1,1,p1,s1,2017-10-06 11:07:15,58.90,13.29",
    "order_payments": "o1,1,credit_card,8,99.33",
    "order_reviews": "r1,o1,4,,good,2018-01-18 00:00:00,2018-01-18 21:46:59",
    "products": "p1,perfumaria,40,287,1,225,16,10,14",
    "sellers": "s1,13023,campinas,SP",
    "geolocation": "01037,-23.54562128,-46.63929204,sao paulo,SP",
    "product_category": "beleza_saude,health_beauty",
}


def read(spark, tmp_path, name, *lines, header=None):
    path = tmp_path / f"{name}.csv"
    head = header if header is not None else ",".join(RAW_TABLES[name].fieldNames())
    path.write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
    return C.read_csv_table(spark, str(path), RAW_TABLES[name])


def test_types_and_leading_zeros(spark, tmp_path):
    row = read(spark, tmp_path, "customers", SAMPLES["customers"]).first()
    assert row["customer_zip_code_prefix"] == "01037"
    row = read(spark, tmp_path, "orders", SAMPLES["orders"]).first()
    assert row["order_purchase_timestamp"] == datetime.datetime(2017, 10, 2, 10, 56, 33)
    assert row["order_delivered_carrier_date"] is None
    row = read(spark, tmp_path, "order_items", SAMPLES["order_items"]).first()
    assert row["price"] == Decimal("58.90") and row["order_item_id"] == 1
    assert read(spark, tmp_path, "order_reviews", SAMPLES["order_reviews"]).first()["review_score"] == 4


def test_timestamps_have_no_zone(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        df = read(spark, tmp_path, "orders", SAMPLES["orders"])
        day = df.selectExpr("string(cast(order_purchase_timestamp as date)) d", "string(order_purchase_timestamp) t").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(day) == ("2017-10-02", "2017-10-02 10:56:33")


def test_quotes_commas_and_newlines(spark, tmp_path):
    line = 'r1,o1,5,"a, b","he said ""hi""\nand left",2018-01-18 00:00:00,2018-01-18 21:46:59'
    rows = read(spark, tmp_path, "order_reviews", line, SAMPLES["order_reviews"]).collect()
    assert len(rows) == 2
    first = min(rows, key=lambda r: r["review_score"] != 5)
    assert first["review_comment_title"] == "a, b"
    assert first["review_comment_message"] == 'he said "hi"\nand left'


REVIEW = 'r{k},o{k},{score},{title},"{message}",2018-01-18 00:00:00,2018-01-18 21:46:59'


def reviews(n, seed):
    """Reviews whose messages hold up to 30 lines, quotes, commas and blank lines."""
    chosen = random.Random(seed)
    parts = ["", "a", "é, 漢", 'he said ""hi""', '""', "x" * 200, ",", "r1,o1,5,,,,"]
    out = []
    for k in range(n):
        lines = [chosen.choice(parts) for _ in range(chosen.choice([1, 1, 1, 2, 30]))]
        out.append((f"r{k}", chosen.randint(1, 5), chosen.choice(["", '"t, u"', "v"]), "\n".join(lines)))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fields_that_span_lines_do_not_keep_files_whole(spark, tmp_path, end):
    """Records over block borders, several files, and more tasks than files."""
    folder, expected = tmp_path / "reviews", {}
    folder.mkdir()
    for part in range(3):
        rows = [(f"{part}{key}", *rest) for key, *rest in reviews(200, part)]
        expected |= {key: (score, title.strip('"') or None, message.replace('""', '"')) for key, score, title, message in rows}
        lines = [",".join(RAW_TABLES["order_reviews"].fieldNames()), *(REVIEW.format(k=key, score=s, title=t, message=m) for key, s, t, m in rows)]
        (folder / f"{part}.csv").write_bytes((end * 2 + end.join("\n".join(lines).split("\n")) + end).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = C.read_csv_table(spark, str(folder), RAW_TABLES["order_reviews"])
        rows = df.collect()
        scanned = numbered_lines(spark, str(folder)).rdd.getNumPartitions()
        assert quote_blocks(numbered_lines(spark, str(folder))).where("before % 2 = 1").count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert scanned > 30
    assert len(rows) == len(expected)
    got = {r["review_id"][1:]: (r["review_score"], r["review_comment_title"], r["review_comment_message"]) for r in rows}
    assert got == expected


def test_only_blocks_with_open_quotes_move(spark, tmp_path):
    df = read(spark, tmp_path, "customers", 'c1,u1,1,"a\nb",SP', SAMPLES["customers"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\w+)#", plan))
    assert moved == {("file", "block"), ("file", "_groupingexpression")}  # lines of such blocks; lines of such records
    assert sorted(r["customer_city"] for r in df.collect()) == ["a\nb", "sao paulo"]
    plain = read(spark, tmp_path, "customers", 'c1,u1,1,"a ""b"" c",SP')
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_counting_quotes_sorts_no_lines(spark, tmp_path):
    """The scan of a block keeps one row in memory, however long the block is."""
    (tmp_path / "lines.csv").write_text('a,b\n\n"x\ny",1\n')
    sums = csv_records.block_sums(numbered_lines(spark, str(tmp_path / "lines.csv")))
    assert "Sort" not in sums._jdf.queryExecution().executedPlan().toString()
    assert [(r["n_odd"], r["first"]) for r in sums.collect()] == [(2, 0)]


def test_an_open_field_names_its_file(spark, tmp_path):
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "good.csv").write_text('a,b\n"x\ny",1\n')
    (tmp_path / "open" / "bad.csv").write_text('a,b\n"x,1\n')
    with pytest.raises(ValueError, match="MALFORMED_RECORD: .*bad.csv ends within a quoted field"):
        quote_blocks(numbered_lines(spark, str(tmp_path / "open")))


def test_blocks_may_be_too_many_to_send(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(csv_records, "SENT_BLOCKS", 0)
    rows = read(spark, tmp_path, "customers", 'c1,u1,1,"a\n\nb",SP', SAMPLES["customers"]).collect()
    assert sorted(r["customer_city"] for r in rows) == ["a\n\nb", "sao paulo"]


def test_header_may_span_lines(spark, tmp_path):
    rows = read(spark, tmp_path, "sellers", SAMPLES["sellers"], header='a,"b\nc",d,e').collect()
    assert [r["seller_id"] for r in rows] == ["s1"]


@pytest.mark.parametrize(
    "lines",
    [
        ['s1,1,"a,SP'],  # no end
        ['s1,1,5" pipe,SP', 's2,1,6" pipe,SP'],  # quotes within unquoted fields, an odd number a line
        ['s1,1,"a\nb",SP,extra'],
        ['s1,1,"a\nb"', SAMPLES["sellers"]],
    ],
)
def test_bad_records_over_lines_abort(spark, tmp_path, lines):
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read(spark, tmp_path, "sellers", SAMPLES["sellers"], *lines).collect()


def test_empty_and_quoted_empty(spark, tmp_path):
    row = read(spark, tmp_path, "sellers", 's1,,"",SP').first()
    assert row["seller_zip_code_prefix"] is None
    assert row["seller_city"] == ""


def test_header_text_is_ignored(spark, tmp_path):
    row = read(spark, tmp_path, "sellers", SAMPLES["sellers"], header="w,x,y,z").first()
    assert row["seller_id"] == "s1"


def test_decimals_are_rescaled(spark, tmp_path):
    row = read(spark, tmp_path, "geolocation", SAMPLES["geolocation"]).first()
    assert row["geolocation_lat"] == Decimal("-23.545621")
    row = read(spark, tmp_path, "order_payments", "o1,1,voucher,1,2.345").first()
    assert row["payment_value"] == Decimal("2.35")


@pytest.mark.parametrize(
    ("name", "line"),
    [
        ("order_payments", "o1,x,voucher,1,1.00"),
        ("order_payments", "o1,5.0,voucher,1,1.00"),
        ("order_payments", "o1,1,voucher,1,123456789.00"),
        ("order_payments", "o1,1,voucher"),
        ("order_payments", "o1,1,voucher,1,1.00,extra"),
        ("order_payments", 'o1,"",voucher,1,1.00'),
        ("order_reviews", "r1,o1,40000,,,2018-01-18 00:00:00,2018-01-18 00:00:00"),
        ("orders", "o1,c1,delivered,not a date,,,,"),
    ],
)
def test_bad_input_aborts(spark, tmp_path, name, line):
    good = SAMPLES[name]
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        read(spark, tmp_path, name, good, line).collect()


def test_load_all(spark, tmp_path):
    raw, target = tmp_path / "raw", str(tmp_path / "tables")
    raw.mkdir()
    for name, line in SAMPLES.items():
        read(spark, raw, name, line)
    (raw / "sellers.csv").rename(raw / "shops.csv")
    tables = C.load_all(spark, str(raw), target, {"sellers": "shops.csv"})
    assert list(tables) == list(RAW_TABLES)
    counts = {r["table_name"]: r["n_rows"] for r in C.load_report(tables).collect()}
    assert counts == dict.fromkeys(RAW_TABLES, 1)
    for name, table in tables.items():
        assert [f.dataType for f in table.schema] == [f.dataType for f in RAW_TABLES[name]]


def test_loading_replaces_the_table(spark, tmp_path):
    target = str(tmp_path / "tables")
    read(spark, tmp_path, "sellers", SAMPLES["sellers"], "s2,1,x,RJ")
    assert C.load_table(spark, "sellers", str(tmp_path / "sellers.csv"), target).count() == 2
    read(spark, tmp_path, "sellers", "s3,1,x,RJ")
    assert C.load_table(spark, "sellers", str(tmp_path / "sellers.csv"), target).count() == 1


@pytest.mark.parametrize("line", ["s1,2,other,RJ", ",2,other,RJ"])
def test_loading_enforces_the_key(spark, tmp_path, line):
    read(spark, tmp_path, "sellers", SAMPLES["sellers"], line)
    with pytest.raises(QualityError, match="sellers: key seller_id"):
        C.load_table(spark, "sellers", str(tmp_path / "sellers.csv"), str(tmp_path / "tables"))


@pytest.mark.parametrize("bad", [["s3,1,x,RJ", "s3,2,y,RJ"], ["s4,1,x"]])
def test_a_refused_load_keeps_the_table(spark, tmp_path, bad):
    target = str(tmp_path / "tables")
    read(spark, tmp_path, "sellers", SAMPLES["sellers"], "s2,1,x,RJ")
    C.load_table(spark, "sellers", str(tmp_path / "sellers.csv"), target)
    read(spark, tmp_path, "sellers", *bad)
    with pytest.raises(Exception, match="key seller_id|MALFORMED|FAILED_READ_FILE|FAILED"):
        C.load_table(spark, "sellers", str(tmp_path / "sellers.csv"), target)
    assert sorted(r.seller_id for r in spark.read.parquet(f"{target}/sellers").collect()) == ["s1", "s2"]
    assert [p.name for p in (tmp_path / "tables").iterdir()] == ["sellers"]


def test_keys_are_columns_of_their_tables():
    for name, key in PRIMARY_KEYS.items():
        assert key in RAW_TABLES[name].fieldNames()


def test_row_counts_of_stored_tables(spark, tmp_path):
    stored = write_table(spark.range(7), str(tmp_path / "a" / "b"))
    assert [tuple(r) for r in row_counts({"numbers": stored}).collect()] == [("numbers", 7)]
