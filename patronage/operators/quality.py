"""Data-quality rules, checked in one aggregation over all rows.

``check`` reports violations as a DataFrame; ``enforce`` raises on them. A ``Watch`` counts
them while the rows are being written, without a scan of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.columns import count_where, hash_order, is_missing, rows_from
from patronage.schemas import CUSTOMER_KEY, FEATURE_SCHEMA, PRIMARY_KEYS, RFM_SCHEMA, TARGET


class QualityError(ValueError):
    """Rows that break a rule; the message lists every broken rule."""


@dataclass(frozen=True)
class Rule:
    """``violations`` is an aggregate: how many rows break the rule. A rule of ``keys``
    compares rows with each other, so it cannot be counted as they pass by."""

    name: str
    violations: Column
    keys: bool = False


def not_missing(df: DataFrame, *columns: str) -> list[Rule]:
    return [Rule(f"{c} is present", count_where(is_missing(df, c))) for c in columns]


def at_least(bound: int, *columns: str) -> list[Rule]:
    return [Rule(f"{c} >= {bound}", count_where(F.col(c) < bound)) for c in columns]


def one_of(column: str, *values: int) -> Rule:
    allowed = ", ".join(str(v) for v in values)
    return Rule(f"{column} in ({allowed})", count_where(~F.col(column).isin(*values)))


def unique(column: str) -> Rule:
    """Rows beyond the first of each key; a NULL key counts as one beyond."""
    return Rule(f"{column} is unique", F.count(F.lit(1)) - F.countDistinct(column), keys=True)


def rfm_rules(df: DataFrame) -> list[Rule]:
    return [
        unique(CUSTOMER_KEY),
        *not_missing(df, "recency_days", "frequency", "monetary", TARGET),
        one_of(TARGET, 0, 1),
        *at_least(1, "frequency"),
        *at_least(0, "monetary", "recency_days"),
    ]


def raw_rules(df: DataFrame) -> list[Rule]:
    """One RFM row: every column present, measures non-negative, label 0 or 1."""
    return [
        *not_missing(df, *RFM_SCHEMA.fieldNames()),
        *at_least(0, "recency_days"),
        *at_least(1, "frequency"),
        *at_least(0, "monetary", "customer_lifetime_days", "avg_days_between_orders"),
        Rule(f"{TARGET} between 0 and 1", count_where(~F.col(TARGET).between(0, 1))),
    ]


def engineered_rules(df: DataFrame) -> list[Rule]:
    """One engineered row: every column present, five of them non-negative."""
    return [
        *(
            Rule(f"{c} is present", count_where(F.col(c).isNull()))
            for c in FEATURE_SCHEMA.fieldNames()
        ),
        *at_least(
            0, "recency_days", "frequency", "monetary", "avg_order_value", "days_per_order"
        ),
    ]


def score_rules(df: DataFrame) -> list[Rule]:
    """Scores of found customers are within bounds; of others they are NULL."""
    found = F.col("found")
    scores = ["churn_probability", "churn_prediction"]
    return [
        Rule(
            "churn_probability between 0 and 1",
            count_where(~F.col("churn_probability").between(0, 1)),
        ),
        one_of("churn_prediction", 0, 1),
        *(Rule(f"{c} is NULL only if not found", count_where(F.col(c).isNull() & found)) for c in scores),
        *(Rule(f"{c} is NULL if not found", count_where(F.col(c).isNotNull() & ~found)) for c in scores),
    ]


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, n_violations), one row per rule, from a single aggregation."""
    totals = df.agg(*(r.violations.cast("bigint").alias(f"r{i}") for i, r in enumerate(rules)))
    lines = [
        (F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("n_violations"))
        for i, r in enumerate(rules)
    ]
    return totals.select(F.inline(rows_from(lines)))


def _refuse(violations: dict[str, int], what: str) -> None:
    broken = {rule: n for rule, n in violations.items() if n}
    if broken:
        listed = "; ".join(f"{rule}: {n} rows" for rule, n in broken.items())
        raise QualityError(f"{what} breaks {len(broken)} rules: {listed}")


def _violations(df: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    return {r["rule"]: r["n_violations"] for r in check(df, rules).collect()} if rules else {}


def enforce(df: DataFrame, rules: Sequence[Rule], what: str) -> None:
    _refuse(_violations(df, rules), what)


class Watch:
    """Rules on rows that are about to be written.

    ``on`` gives the rows to write; their breaches are counted in that same job. Afterwards
    ``enforce`` takes the stored rows and raises on a breach. It reads them for rules of keys only, and
    of those only the key. A stage that has to be run again counts its rows again, so
    counts may be too high after the loss of an executor, but none becomes or misses a breach by that.
    """

    def __init__(self, rules: Sequence[Rule], what: str):
        self.passing = [r for r in rules if not r.keys]
        self.keys = [r for r in rules if r.keys]
        self.what = what
        self.observation = Observation()

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *(r.violations.cast("bigint").alias(r.name) for r in self.passing))

    def enforce(self, stored: DataFrame) -> None:
        # Rows that the optimizer knows to be none are not counted.
        counted = self.observation.get or dict.fromkeys((r.name for r in self.passing), 0)
        _refuse({**_violations(stored, self.keys), **counted}, self.what)


def check_types(df: DataFrame, schema: T.StructType, what: str) -> None:
    """Strict types: the columns of ``schema``, each with exactly its type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name} is {actual[f.name].simpleString() if f.name in actual else 'absent'}"
        f" instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise QualityError(f"{what}: {'; '.join(wrong)}")


def validate_rfm(df: DataFrame) -> None:
    enforce(df, rfm_rules(df), "RFM table")


def watch_rfm(df: DataFrame) -> Watch:
    """The rules of ``validate_rfm``, for rows about to be written."""
    return Watch(rfm_rules(df), "RFM table")


def watch_features(df: DataFrame) -> Watch:
    """The rules of ``validate_schema`` for all rows, which are about to be written. Wrong types raise at once."""
    check_types(df, FEATURE_SCHEMA, "feature table")
    return Watch(engineered_rules(df), "feature table")


def validate_raw(df: DataFrame) -> None:
    check_types(df, RFM_SCHEMA, "RFM table")
    enforce(df, raw_rules(df), "RFM table")


def validation_sample(df: DataFrame, sample_size: int = 500, seed: int = 42) -> DataFrame:
    """At most ``sample_size`` rows, the same ones on every run and layout."""
    return df.orderBy(hash_order(CUSTOMER_KEY, seed), CUSTOMER_KEY).limit(sample_size)


def validate_schema(df: DataFrame, sample_size: int | None = None, seed: int = 42) -> None:
    """Types and rules of engineered rows.

    All rows by default: the scan is one aggregation, and a sample would miss
    rare breaches. With ``sample_size``, only the rows of the seeded sample.
    """
    check_types(df, FEATURE_SCHEMA, "feature table")
    rows = df if sample_size is None else validation_sample(df, sample_size, seed)
    enforce(rows, engineered_rules(rows), "feature table")


# --- keys and nulls ----------------------------------------------------------------


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row or with a NULL, and their number of rows."""
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(key).isNull()
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where((F.col("n_rows") > 1) | has_null)
    )


def pk_violations(
    tables: dict[str, DataFrame], keys: dict[str, str] = PRIMARY_KEYS
) -> DataFrame:
    """Per table with a key: keys that repeat, and rows without a key."""
    parts = [
        duplicate_keys(df, keys[name]).agg(
            F.lit(name).alias("table_name"),
            count_where(F.col(keys[name]).isNotNull()).alias("n_repeated_keys"),
            F.coalesce(
                F.sum(F.when(F.col(keys[name]).isNull(), F.col("n_rows"))), F.lit(0)
            ).alias("n_null_rows"),
        )
        for name, df in tables.items()
        if name in keys
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def enforce_primary_key(df: DataFrame, key: str, table: str) -> None:
    """Raise on a repeated or missing key, naming one."""
    worst = F.max_by(F.struct(key, "n_rows"), "n_rows").alias("worst")
    bad = duplicate_keys(df, key).agg(worst).first()["worst"]
    if bad is not None:
        raise QualityError(f"{table}: key {key} = {bad[key]!r} has {bad['n_rows']} rows")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_nulls) by one aggregation; NaN counts as NULL."""
    columns = list(columns or df.columns)
    totals = df.agg(*(count_where(is_missing(df, c)).alias(c) for c in columns))
    lines = [(F.lit(c).alias("column_name"), F.col(c).alias("n_nulls")) for c in columns]
    return totals.select(F.inline(rows_from(lines)))


def key_uniqueness(df: DataFrame, key: str = CUSTOMER_KEY) -> DataFrame:
    """One row: rows, distinct keys, and rows beyond the first of each key."""
    n_rows, n_keys = F.count(F.lit(1)), F.countDistinct(key)
    return df.agg(
        n_rows.alias("n_rows"), n_keys.alias("n_keys"), (n_rows - n_keys).alias("n_duplicates")
    )
