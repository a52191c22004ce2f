"""Named queries over the star schema, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions import features as X
from patronage.operators import lookup, metrics, orders, profile, quality, rfm, split
from patronage.plans import registry, scoring, sql, training
from patronage.plans.pipeline import build_features, build_rfm_dataset
from patronage.schemas import CUSTOMER_KEY, RAW_TABLES
from patronage.session import new_path
from patronage.sources.csv_tables import load_all, load_table
from patronage.sources.parquet_tables import open_store, read_table, row_counts
from patronage.sources.star_tables import FULFILLED, keyed_tables, star_tables
from patronage.streaming.scoring_stream import files_for_batches, request_stream, score_stream, stored_scores

Query = Callable[[SparkSession, str], DataFrame]

# Trees of the model that the scoring queries use.
ROUNDS = training.N_ESTIMATORS
# A repeat customer at every scale factor as generated; tables with other keys may lack it.
LOOKED_UP = "4"
# Micro-batches of the streaming query at most, however many files its requests come in.
STREAM_BATCHES = 3
SWEEP_DAYS = (30, 60, 90, 120, 180, 270, 365)


def _cutoff(tables, churn_days: int = orders.CHURN_DAYS):
    return orders.resolve_dates(tables["orders"], churn_days, FULFILLED).cutoff_dt


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """All customers of the feature window, so that one-order rows exist."""
    tables = star_tables(spark, folder)
    return rfm.customer_rfm(tables, _cutoff(tables), FULFILLED)


def _metrics(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tables = star_tables(spark, folder)
    cutoff = _cutoff(tables)
    return (
        rfm.rfm_metrics_nowindow(tables, cutoff, FULFILLED),
        orders.active_after_cutoff(tables, cutoff, FULFILLED),
    )


# --- stored products of earlier steps ----------------------------------------------

_products: dict[tuple, object] = {}


def _once(spark: SparkSession, product: str, folder: str, build: Callable[[], object]):
    """What ``build`` stores for a data folder, built once per application."""
    key = (spark.sparkContext.applicationId, product, folder)
    if key not in _products:
        _products[key] = build()
    return _products[key]


def feature_path(spark: SparkSession, folder: str) -> str:
    """The stored feature table, from the steps that lead to it."""

    def build() -> str:
        rfm_path, path = new_path(spark, "rfm"), new_path(spark, "features")
        build_rfm_dataset(star_tables(spark, folder, text_keys=True), rfm_path, status=FULFILLED)
        build_features(spark, rfm_path, path)
        return path

    return _once(spark, "features", folder, build)


def _text_store(spark: SparkSession, folder: str) -> DataFrame:
    return open_store(spark, feature_path(spark, folder))


def _numbered(df: DataFrame, key: str = CUSTOMER_KEY) -> DataFrame:
    """Keys as the star schema has them."""
    return df.withColumn(key, F.col(key).cast("bigint"))


def _store(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(_text_store(spark, folder))


def _registry(spark: SparkSession, folder: str) -> str:
    """A registry with the run and the model version of one training."""

    def build() -> str:
        where = new_path(spark, "registry")
        training.train(spark, feature_path(spark, folder), where, ROUNDS)
        return where

    return _once(spark, "registry", folder, build)


def _model(spark: SparkSession, folder: str) -> tuple[PipelineModel, int]:
    return registry.load_latest(spark, _registry(spark, folder))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """The customer of every order asks for a score; many ask repeatedly, and
    those without enough orders before the cutoff are unknown."""
    return star_tables(spark, folder)["orders"].select(
        F.col("order_id").alias("pos"), "customer_id"
    )


# --- RFM ---------------------------------------------------------------------------


def rfm_churn(spark, folder):
    return rfm.rfm(star_tables(spark, folder), status=FULFILLED)


def rfm_sql_param(spark, folder):
    return sql.compute_rfm(star_tables(spark, folder), status=FULFILLED)


def rfm_identity_merge(spark, folder):
    return rfm.rfm(star_tables(spark, folder, logins_per_person=2), status=FULFILLED)


def rfm_returned_items(spark, folder):
    tables = star_tables(spark, folder, items=F.col("l_returnflag") == "R")
    return rfm.rfm(tables, status=FULFILLED)


def table_row_counts(spark, folder):
    return row_counts(keyed_tables(spark, folder))


def pk_violations(spark, folder):
    return quality.pk_violations(keyed_tables(spark, folder))


def duplicate_item_keys(spark, folder):
    items = star_tables(spark, folder)["order_items"]
    return quality.duplicate_keys(items, "order_id", "order_item_id")


def reference_dates(spark, folder):
    return orders.reference_dates(star_tables(spark, folder)["orders"], status=FULFILLED)


def _window_rows(spark, folder, **options):
    tables = star_tables(spark, folder, **options)
    return orders.delivered_before_cutoff(tables, _cutoff(tables), FULFILLED)


def delivered_before_cutoff(spark, folder):
    return _window_rows(spark, folder)


def delivered_before_cutoff_collapse(spark, folder):
    return _window_rows(spark, folder, payment="l_quantity")


def delivered_before_cutoff_returned_items(spark, folder):
    return _window_rows(spark, folder, items=F.col("l_returnflag") == "R")


def order_gaps(spark, folder):
    # Rows of one day are interchangeable, so the order is left out.
    return rfm.order_gaps(_window_rows(spark, folder)).select(
        CUSTOMER_KEY, "order_date", "days_since_previous_order"
    )


def rfm_metrics(spark, folder):
    tables = star_tables(spark, folder)
    cutoff = _cutoff(tables)
    rows = orders.delivered_before_cutoff(tables, cutoff, FULFILLED)
    return rfm.rfm_metrics(rfm.order_gaps(rows), cutoff)


def rfm_metrics_nowindow(spark, folder):
    return _metrics(spark, folder)[0]


def active_after_cutoff(spark, folder):
    return _metrics(spark, folder)[1]


def churn_labels(spark, folder):
    return rfm.churn_labels(*_metrics(spark, folder))


def churned_customers(spark, folder):
    return rfm.churned_customers(*_metrics(spark, folder))


def retained_customers(spark, folder):
    return rfm.retained_customers(*_metrics(spark, folder))


def churn_sweep(spark, folder):
    return rfm.churn_sweep(star_tables(spark, folder), SWEEP_DAYS, FULFILLED)


def top_recent_customers(spark, folder):
    labelled = rfm.rfm(star_tables(spark, folder), status=FULFILLED, ordered=False)
    return rfm.top_recent_customers(labelled)


# --- feature columns -----------------------------------------------------------------


def monetary_log(spark, folder):
    df = X.add_monetary_log(_labelled(spark, folder))
    return df.select(CUSTOMER_KEY, "monetary", F.round("monetary_log", 6).alias("monetary_log"))


def avg_order_value(spark, folder):
    df = X.add_avg_order_value(_labelled(spark, folder))
    return df.select(CUSTOMER_KEY, "avg_order_value")


def days_per_order(spark, folder):
    df = X.add_days_per_order(_labelled(spark, folder))
    return df.select(CUSTOMER_KEY, "days_per_order")


def one_time_flag(spark, folder):
    df = X.add_one_time_buyer_flag(_labelled(spark, folder))
    return df.select(CUSTOMER_KEY, "frequency", "is_one_time_buyer")


def impute_gaps(spark, folder):
    df = X.fill_missing_gaps(_metrics(spark, folder)[0])
    return df.select(CUSTOMER_KEY, "avg_days_between_orders")


def _rounded_log(df: DataFrame) -> DataFrame:
    return df.withColumn("monetary_log", F.round("monetary_log", 6))


def engineered_features(spark, folder):
    """All customers, straight from the raw tables in one plan."""
    return _rounded_log(X.engineer(_labelled(spark, folder)))


def build_features_stored(spark, folder):
    """Repeat customers, as the stored steps leave them."""
    return _rounded_log(_store(spark, folder))


# --- quality and profile ---------------------------------------------------------------


def rfm_violations(spark, folder):
    df = rfm.rfm(star_tables(spark, folder), status=FULFILLED, ordered=False)
    return quality.check(df, quality.rfm_rules(df))


def rfm_violations_two_snapshots(spark, folder):
    """Two cutoffs in one table break the uniqueness of the key."""
    tables = star_tables(spark, folder)
    both = [rfm.rfm(tables, d, FULFILLED, ordered=False) for d in (90, 180)]
    df = both[0].unionByName(both[1])
    return quality.check(df, quality.rfm_rules(df))


def raw_violations(spark, folder):
    """Metrics without imputation: customers with one row have no gap."""
    measured, active = _metrics(spark, folder)
    df = rfm.churn_labels(measured, active, impute=False)
    return quality.check(df, quality.raw_rules(df))


def engineered_violations(spark, folder):
    df = _store(spark, folder)
    return quality.check(df, quality.engineered_rules(df))


def validation_sample(spark, folder):
    return quality.validation_sample(_store(spark, folder)).select(CUSTOMER_KEY)


def key_uniqueness(spark, folder):
    rows = _window_rows(spark, folder)
    return quality.key_uniqueness(rows)


def null_counts(spark, folder):
    return quality.null_counts(_metrics(spark, folder)[0])


def churn_rate(spark, folder):
    return profile.churn_rate(_store(spark, folder))


def class_distribution(spark, folder):
    return profile.class_distribution(_store(spark, folder))


def describe_features(spark, folder):
    df = profile.describe(_store(spark, folder).drop(CUSTOMER_KEY))
    text = ["column_name", "n"]
    return df.select(*text, *(F.round(c, 6).alias(c) for c in df.columns if c not in text))


# --- model -----------------------------------------------------------------------------


def _split(spark, folder):
    return split.split_data(_store(spark, folder))


def stratified_split(spark, folder):
    return _split(spark, folder).select(CUSTOMER_KEY, "churn_label", "side")


def class_weights(spark, folder):
    return split.class_weights(_split(spark, folder).where(F.col("side") == split.TRAIN))


def weighted_rows(spark, folder):
    """Training rows with their weight."""
    train = _split(spark, folder).where(F.col("side") == split.TRAIN)
    ratio = train.agg(split.class_ratio().alias("ratio")).first()["ratio"]
    return split.add_weight(train, ratio).select(
        CUSTOMER_KEY, "churn_label", F.round("weight", 6).alias("weight")
    )


def auc_rank_sum(spark, folder):
    df = metrics.auc(_store(spark, folder), "recency_days")
    return df.select(F.round("auc", 9).alias("auc"))


def precision_recall(spark, folder):
    guess = (F.col("recency_days") > 180).cast("int")
    df = _store(spark, folder).withColumn("guess", guess)
    return metrics.precision_recall(df, "guess")


def train_metrics(spark, folder):
    """The metrics of the trained model, from its logged run."""
    run = registry.latest_run(spark, _registry(spark, folder))
    return run.select(F.explode("metrics").alias("metric", "value"))


def run_log(spark, folder):
    run = registry.best_run(spark, _registry(spark, folder))
    params = run.select(F.explode("params").alias("param", "value"))
    # Where the features lie differs between runs; that the run names them does not.
    known = F.lit(feature_path(spark, folder))
    shown = F.when(F.col("value") == known, "features").otherwise(F.col("value"))
    return params.select("param", F.when(F.col("param") == "features_path", shown).otherwise(F.col("value")).alias("value"))


# --- scoring -----------------------------------------------------------------------------


def lookup_customer(spark, folder):
    return _rounded_log(_numbered(lookup.lookup_customer(_text_store(spark, folder), LOOKED_UP)))


def batch_lookup(spark, folder):
    store = _store(spark, folder).select(CUSTOMER_KEY, "recency_days", "frequency", "monetary")
    return lookup.answer_requests(_requests(spark, folder), store).orderBy("pos")


def batch_summary(spark, folder):
    store = _store(spark, folder).select(CUSTOMER_KEY)
    return lookup.batch_summary(lookup.answer_requests(_requests(spark, folder), store))


def store_status(spark, folder):
    version = registry.latest_version(spark, _registry(spark, folder))
    return scoring.store_status(_store(spark, folder), version)


def score_customer(spark, folder):
    """One customer scored; like ``lookup_customer``, no row if the store does not have the id."""
    model, version = _model(spark, folder)
    return _numbered(
        scoring.score_if_known(model, _text_store(spark, folder), LOOKED_UP, version), "customer_id"
    )


def _text_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the key type of the stored features, so that their buckets serve."""
    return _requests(spark, folder).withColumn("customer_id", F.col("customer_id").cast("string"))


def score_batch(spark, folder):
    model, _ = _model(spark, folder)
    scored = scoring.score_batch(model, _text_store(spark, folder), _text_requests(spark, folder))
    return _numbered(scored, "customer_id")


def score_summary(spark, folder):
    model, version = _model(spark, folder)
    scored = scoring.score_batch(
        model, _text_store(spark, folder), _text_requests(spark, folder), ordered=False
    )
    return scoring.score_summary(scored, version)


def batch_event(spark, folder):
    """The event of a batch whose requests are looked up, not scored."""
    version = registry.latest_version(spark, _registry(spark, folder))
    summary = batch_summary(spark, folder).withColumn("model_version", F.lit(str(version)))
    return scoring.batch_events(summary)


def score_violations(spark, folder):
    df = score_batch(spark, folder)
    return quality.check(df, quality.score_rules(df))


def scoring_events(spark, folder):
    """One event per customer of the store, and one for the batch of requests."""
    model, version = _model(spark, folder)
    store = _store(spark, folder)
    each = scoring.score_store(model, store).select(
        F.col(CUSTOMER_KEY).alias("customer_id"),
        *scoring.SCORES,
        F.lit(str(version)).alias("model_version"),
    )
    return scoring.score_events(each).unionByName(
        scoring.batch_events(score_summary(spark, folder))
    )


def score_stream_available(spark, folder):
    """The requests as files, scored by a stream that ends when all are read, in a few micro-batches of whole files."""
    model, _ = _model(spark, folder)
    inbox, outbox, state, at = (new_path(spark, n) for n in ("inbox", "outbox", "stream-state", "scores"))
    requests = _text_requests(spark, folder)
    requests.write.parquet(inbox)
    at_once = files_for_batches(spark, inbox, STREAM_BATCHES)
    arriving = request_stream(spark, inbox, requests.schema, files_per_trigger=at_once)
    scores = stored_scores(model, _text_store(spark, folder), at)
    score_stream(scores, arriving, outbox, state).awaitTermination()
    columns = ["pos", "customer_id", *scoring.SCORES, "found"]
    return _numbered(spark.read.parquet(outbox).select(*columns), "customer_id")


def _judged(scored: DataFrame) -> DataFrame:
    """What can be said of each score without knowing the trees."""
    found, chance = F.col("found"), F.col("churn_probability")
    return scored.select(
        "pos",
        "customer_id",
        "found",
        F.when(found, chance.between(0, 1)).otherwise(chance.isNull()).alias("in_bounds"),
        F.when(found, F.col("churn_prediction") == (chance > 0.5).cast("int"))
        .otherwise(F.col("churn_prediction").isNull())
        .alias("consistent"),
    )


def score_batch_judged(spark, folder):
    return _judged(score_batch(spark, folder))


def score_stream_judged(spark, folder):
    return _judged(score_stream_available(spark, folder))


def score_customer_judged(spark, folder):
    """One customer scored with its event, if the store has it, and an id that the store does not have."""
    model, version = _model(spark, folder)
    store = _text_store(spark, folder)
    asked = spark.createDataFrame([(LOOKED_UP,)], "customer_id string")
    one = scoring.score_if_known(model, store, LOOKED_UP, version)
    event = F.from_json("event_json", "event string, customer_id string, churn_probability double, churn_prediction int, model_version string")
    said = scoring.score_events(one).select(event.alias("e")).select("e.*")
    chance = F.col("churn_probability")
    known = said.join(asked, "customer_id").select(
        "customer_id", "event", "model_version", chance.between(0, 1).alias("in_bounds"),
        (F.col("churn_prediction") == (chance > 0.5).cast("int")).alias("consistent"), F.lit(None).cast("string").alias("error"),
    )
    try:
        unknown = scoring.score_customer(model, store, "-1", version).select(*known.columns)
    except LookupError as error:
        row = [("-1", "absent" if "-1" in str(error) else str(error))]
        unknown = spark.createDataFrame(row, "customer_id string, error string")
    return known.unionByName(unknown, allowMissingColumns=True)


def model_matrix(spark, folder):
    """The columns that the model is given, in their order, with rows and bounds of the assembled matrix."""
    model, _ = _model(spark, folder)
    assembler = model.stages[0]
    cells = assembler.transform(_store(spark, folder)).select(F.posexplode(vector_to_array(assembler.getOutputCol())).alias("pos", "value"))
    names = F.array(*(F.lit(c) for c in assembler.getInputCols()))
    bounds = [F.round(f("value"), 6).alias(name) for f, name in ((F.min, "lowest"), (F.max, "highest"))]
    found = cells.groupBy("pos").agg(F.count(F.lit(1)).alias("n_rows"), *bounds)
    return found.select("pos", names[F.col("pos")].alias("column_name"), "n_rows", "lowest", "highest")


def score_customers_judged(spark, folder):
    """Every customer of the store scored, and asked for as one request each."""
    model, _ = _model(spark, folder)
    store = _store(spark, folder)
    asked = store.select(F.col(CUSTOMER_KEY).alias("pos"), F.col(CUSTOMER_KEY).alias("customer_id"))
    return _judged(scoring.score_batch(model, store, asked))


def metrics_in_bounds(spark, folder):
    """The logged metrics of the training, each between 0 and 1, and its class ratio above 0."""
    run = registry.latest_run(spark, _registry(spark, folder))
    values = run.select(F.explode("metrics").alias("metric", "value"))
    return values.select("metric", ((F.col("value") >= 0) & ((F.col("value") <= 1) | (F.col("metric") == "scale_pos_weight"))).alias("in_bounds"))


def _csv_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Raw tables made of the given ones, as text: quoted commas, quoted empty and missing
    fields, and decimals with more digits than are declared."""
    tables = keyed_tables(spark, folder)
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = lambda c: F.col(c).cast("string")
    when = F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
    nothing = F.lit(None).cast("string")
    return {
        "customers": tables["customers"].select(
            text("customer_id").alias("customer_id"),
            text("customer_unique_id").alias("customer_unique_id"),
            F.lpad(text("customer_id"), 8, "0").alias("customer_zip_code_prefix"),
            F.concat(F.lit("town, "), text("customer_id")).alias("customer_city"),
            F.when(F.col("customer_id") % 2 == 0, "").otherwise(nothing).alias("customer_state"),
        ),
        "orders": tables["orders"].select(
            text("order_id").alias("order_id"), text("customer_id").alias("customer_id"), "order_status",
            when.alias("order_purchase_timestamp"),
            *(nothing.alias(c) for c in RAW_TABLES["orders"].fieldNames()[4:]),
        ),
        "order_items": lines.select(
            text("l_orderkey").alias("order_id"), text("l_linenumber").alias("order_item_id"),
            text("l_partkey").alias("product_id"), text("l_suppkey").alias("seller_id"),
            nothing.alias("shipping_limit_date"),
            (F.col("l_extendedprice").cast("decimal(12,2)") + F.expr("0.0050BD")).cast("string").alias("price"),
            F.col("l_quantity").cast("decimal(12,4)").cast("string").alias("freight_value"),
        ),
        "sellers": tables["sellers"].select(
            text("seller_id").alias("seller_id"), F.lpad(text("seller_id"), 5, "0").alias("seller_zip_code_prefix"),
            F.concat(F.lit('the "old" '), text("seller_id")).alias("seller_city"), F.lit("SP").alias("seller_state"),
        ),
    }


def _loaded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw tables written as CSV and loaded from there."""

    def build() -> str:
        raw, target = new_path(spark, "raw"), new_path(spark, "tables")
        for name, df in _csv_tables(spark, folder).items():
            df.write.csv(f"{raw}/{name}", header=True, quote='"', escape='"', emptyValue='""', nullValue="")
            load_table(spark, name, f"{raw}/{name}", target)
        return target

    target = _once(spark, "loaded", folder, build)
    return {name: read_table(spark, f"{target}/{name}", RAW_TABLES[name]) for name in _csv_tables(spark, folder)}


def load_report(spark, folder):
    """Rows of the loaded tables."""
    return row_counts(_loaded(spark, folder))


def loaded_items(spark, folder):
    """The loaded lines: keys as text, whole numbers, decimals at their declared scale."""
    return _loaded(spark, folder)["order_items"].select("order_id", "order_item_id", "product_id", "price", "freight_value")


def loaded_customers(spark, folder):
    """The loaded customers: leading zeros, commas, empty and missing text."""
    return _loaded(spark, folder)["customers"]


def _all_csv_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All nine raw tables as text. Messages of reviews span lines and hold quotes."""
    tables = _csv_tables(spark, folder)
    orders, lines, part, nation = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("orders", "lineitem", "part", "nation"))
    text = lambda c: F.col(c).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    message = F.concat(F.col("o_orderstatus"), F.lit(' said "'), F.col("o_orderpriority"), F.lit('",\n\nand '), text("o_custkey"))
    made = {
        "order_payments": lines.select(
            text("l_orderkey"), text("l_linenumber"), F.col("l_returnflag"), F.lit("1"), F.col("l_extendedprice").cast("decimal(10,2)").cast("string")
        ),
        "order_reviews": orders.select(
            F.concat(F.lit("r"), text("o_orderkey")), text("o_orderkey"), (F.col("o_custkey") % 5 + 1).cast("string"),
            F.lit(None).cast("string"), F.when(F.col("o_orderkey") % 3 > 0, message), day, day,
        ),
        "products": part.select(
            text("p_partkey"), F.col("p_type"), F.length("p_name").cast("string"), *(F.lit(None).cast("string") for _ in range(4)), text("p_size"), F.lit("7")
        ),
        "geolocation": nation.select(
            F.lpad(text("n_nationkey"), 5, "0"), F.concat(F.lit("-"), text("n_nationkey"), F.lit(".12345678")), F.lit("1.5"), F.col("n_name"), F.lit("SP")
        ),
        "product_category": part.select("p_type").distinct().select("p_type", F.lower("p_type")),
    }
    return {name: {**tables, **made}[name] for name in RAW_TABLES}


def _all_loaded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All raw tables in one load, from files whose headers name no column rightly."""

    def build() -> str:
        raw, target = new_path(spark, "all-raw"), new_path(spark, "all-tables")
        for name, df in _all_csv_tables(spark, folder).items():
            named = df.toDF(*(f"w{len(df.columns) - i}" for i in range(len(df.columns))))
            named.write.csv(f"{raw}/{name}.csv", header=True, quote='"', escape='"', emptyValue='""', nullValue="")
        load_all(spark, raw, target)
        return target

    target = _once(spark, "all-loaded", folder, build)
    return {name: read_table(spark, f"{target}/{name}", RAW_TABLES[name]) for name in RAW_TABLES}


def load_all_report(spark, folder):
    """Rows of all nine tables after one checked load."""
    return row_counts(_all_loaded(spark, folder))


def loaded_reviews(spark, folder):
    """Reviews whose messages span lines, from split files with wrong headers."""
    return _all_loaded(spark, folder)["order_reviews"].drop("review_answer_timestamp")


def loaded_places(spark, folder):
    """Places: columns bound by position, coordinates rescaled."""
    return _all_loaded(spark, folder)["geolocation"]


QUERIES: dict[str, Query] = {
    "rfm_churn": rfm_churn,
    "rfm_sql_param": rfm_sql_param,
    "rfm_identity_merge": rfm_identity_merge,
    "rfm_returned_items": rfm_returned_items,
    "table_row_counts": table_row_counts,
    "pk_violations": pk_violations,
    "duplicate_item_keys": duplicate_item_keys,
    "reference_dates": reference_dates,
    "delivered_before_cutoff": delivered_before_cutoff,
    "delivered_before_cutoff_collapse": delivered_before_cutoff_collapse,
    "delivered_before_cutoff_returned_items": delivered_before_cutoff_returned_items,
    "order_gaps": order_gaps,
    "rfm_metrics": rfm_metrics,
    "rfm_metrics_nowindow": rfm_metrics_nowindow,
    "active_after_cutoff": active_after_cutoff,
    "churn_labels": churn_labels,
    "churned_customers": churned_customers,
    "retained_customers": retained_customers,
    "churn_sweep": churn_sweep,
    "top_recent_customers": top_recent_customers,
    "monetary_log": monetary_log,
    "avg_order_value": avg_order_value,
    "days_per_order": days_per_order,
    "one_time_flag": one_time_flag,
    "impute_gaps": impute_gaps,
    "engineered_features": engineered_features,
    "build_features": build_features_stored,
    "rfm_violations": rfm_violations,
    "rfm_violations_two_snapshots": rfm_violations_two_snapshots,
    "raw_violations": raw_violations,
    "engineered_violations": engineered_violations,
    "validation_sample": validation_sample,
    "key_uniqueness": key_uniqueness,
    "null_counts": null_counts,
    "churn_rate": churn_rate,
    "class_distribution": class_distribution,
    "describe_features": describe_features,
    "stratified_split": stratified_split,
    "class_weights": class_weights,
    "weighted_rows": weighted_rows,
    "auc_rank_sum": auc_rank_sum,
    "precision_recall": precision_recall,
    "train_metrics": train_metrics,
    "run_log": run_log,
    "lookup_customer": lookup_customer,
    "batch_lookup": batch_lookup,
    "batch_summary": batch_summary,
    "store_status": store_status,
    "score_customer": score_customer,
    "score_batch": score_batch,
    "score_summary": score_summary,
    "batch_event": batch_event,
    "score_violations": score_violations,
    "scoring_events": scoring_events,
    "score_stream": score_stream_available,
    "score_batch_judged": score_batch_judged,
    "score_stream_judged": score_stream_judged,
    "score_customers_judged": score_customers_judged,
    "metrics_in_bounds": metrics_in_bounds,
    "load_report": load_report,
    "loaded_items": loaded_items,
    "loaded_customers": loaded_customers,
    "load_all_report": load_all_report,
    "loaded_reviews": loaded_reviews,
    "loaded_places": loaded_places,
    "score_customer_judged": score_customer_judged,
    "model_matrix": model_matrix,
}
