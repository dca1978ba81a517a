"""Every operator as a query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft import functions as fn
from tablecraft import sources
from tablecraft.operators import behavior, factorize, matrix, metrics, ranking, scaling
from tablecraft.operators.asof import asof_features
from tablecraft.operators.exact import exact_totals
from tablecraft.operators.feature_schema import (
    ITEM,
    USER,
    Entity,
    conform,
    group,
    violations,
)
from tablecraft.operators.feature_store import publish_features, read_features
from tablecraft.operators.quality import assert_unique
from tablecraft.operators.latest import latest_features
from tablecraft.operators.sql import run_sql
from tablecraft.plans import churn, reco, retail
from tablecraft.session import scratch_path
from tablecraft.sources.star_schema import StarSchema
from tablecraft.streaming.engagement import read_item_engagement, sync_item_engagement
from tablecraft.streaming.feature_view import read_feature_view, sync_feature_view

Query = Callable[[SparkSession, str], DataFrame]

# All dates there are.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-30"
AGE_DAY = "2001-12-31"
RUN_DATE = "1997-02-03"
YEAR = ("1997-01-01", "1997-12-31")
# The events cover January 2024.
AS_OF = "2024-01-30"
CHURN_RUN_DATE = "2024-01-20"
SNAPSHOTS = ("2024-01-10", "2024-01-20", "2024-01-25")
HALF_TIME = "2024-01-16"
PREMIUM_ABOVE = 5000.0
ITEMS = range(100)
NMF_RANK = 3
CHURN_GATES = {"auc": 0.78, "accuracy": 0.01, "f1": 1.01}
GATES = {"auc": 0.5, "f1": 0.99, "accuracy": 0.2}

_REGISTRY: dict[str, Query] = {}


def query(function: Callable[[StarSchema], DataFrame]) -> Callable[[StarSchema], DataFrame]:
    _REGISTRY[function.__name__] = lambda spark, sf_dir: function(StarSchema(spark, sf_dir))
    return function


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- sources, sinks, tables -------------------------------------------------


@query
def csv_scan(data: StarSchema) -> DataFrame:
    orders = data.table("orders")
    path = scratch_path(data.spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return sources.read_csv(data.spark, path, orders.schema)


@query
def parquet_scan(data: StarSchema) -> DataFrame:
    parts = sources.read_parquet(data.spark, f"{data.directory}/part.parquet")
    return parts


@query
def load_directory(data: StarSchema) -> DataFrame:
    """Row counts of all tables, and the totals of every column of each."""
    found = None
    for name, table in sources.load_dir(data.spark, data.directory).items():
        digest = sources.table_digest(table).select(F.lit(name).alias("table_name"), "*")
        found = digest if found is None else found.unionByName(digest)
    return found


@query
def stage_files(data: StarSchema) -> DataFrame:
    return sources.stage_files(
        data.spark, data.directory, "cust*.parquet", scratch_path(data.spark, "staging")
    )


@query
def write_dispositions(data: StarSchema) -> DataFrame:
    """Truncate twice, then append: the first write must leave no trace."""
    path = scratch_path(data.spark, "accounts")
    customers, suppliers = _accounts(data)
    sources.write_table(suppliers, path, "WRITE_TRUNCATE")
    sources.write_table(customers, path, "WRITE_TRUNCATE")
    sources.write_table(suppliers, path, "WRITE_APPEND")
    return sources.read_parquet(data.spark, path)


@query
def union_all(data: StarSchema) -> DataFrame:
    customers, suppliers = _accounts(data)
    return customers.unionByName(suppliers)


@query
def query_extract(data: StarSchema) -> DataFrame:
    return sources.extract(data.raw_inventory(), scratch_path(data.spark, "extract"))


@query
def custom_sql(data: StarSchema) -> DataFrame:
    return run_sql(
        data.spark,
        sql="""
            SELECT o_orderpriority,
                   COUNT(*) AS order_count,
                   SAFE_DIVIDE(COUNT_IF(o_orderstatus = 'F'),
                               NULLIF(COUNT_IF(o_orderstatus = 'O'), 0)) AS filled_to_open
            FROM {orders}
            WHERE o_orderdate >= CAST(:start AS DATE) - INTERVAL 90 DAY
            GROUP BY o_orderpriority
        """,
        tables={"orders": data.table("orders")},
        args={"start": YEAR[0]},
    )


@query
def literal_rows(data: StarSchema) -> DataFrame:
    """Rows written out in the SQL, joined to a table."""
    return run_sql(
        data.spark,
        sql="""
            SELECT level, COUNT(*) AS part_count
            FROM {part} JOIN (VALUES (0, 'small'), (1, 'medium'), (2, 'medium'), (3, 'large'))
                 AS step(no, level) ON p_size DIV 16 = no
            GROUP BY level
        """,
        tables={"part": data.table("part")},
    )


@query
def stamped_features(data: StarSchema) -> DataFrame:
    """Features without a fixed time carry the query's start, one for all rows."""
    raw = churn.churn_training_raw(data.raw_user_events([CHURN_RUN_DATE]), CHURN_RUN_DATE)
    stamp = F.col("feature_timestamp")
    return churn.churn_features(raw).select(
        "user_id",
        (stamp > F.lit("2024-01-01").cast("timestamp")).alias("is_later"),
        (stamp == F.current_timestamp()).alias("is_query_start"),
    )


@query
def balances_presented(data: StarSchema) -> DataFrame:
    """A sorted report of the 25 largest balances."""
    accounts = _accounts(data)[0].orderBy(F.desc("balance"), "account_id").limit(25)
    return accounts.select("account_id", "balance")


@query
def run_discarded(data: StarSchema) -> DataFrame:
    """A query that is run for its checks only, and then read."""
    customers, _ = _accounts(data)
    sources.discard(assert_unique(customers, ["account_id"]))
    return customers.select("account_id", "balance")


# --- scalar functions -------------------------------------------------------


@query
def scalar_functions(data: StarSchema) -> DataFrame:
    tax, discount, quantity = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    shipped = F.col("l_shipdate")
    return data.table("lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        fn.safe_divide(tax, discount).alias("tax_per_discount"),
        fn.null_if(tax, 0.0).alias("tax_or_null"),
        fn.or_zero(fn.null_if(tax, 0.0)).alias("tax_or_zero"),
        fn.rounded(fn.log1p(quantity), 9).alias("log_quantity"),
        fn.rounded(fn.log1p(1 - F.col("l_linenumber")), 9).alias("log_outside_domain"),
        fn.to_double(F.col("l_linenumber")).alias("linenumber_double"),
        fn.tier(quantity).alias("quantity_tier"),
        fn.flag(F.col("l_returnflag") == "R").alias("is_returned"),
        fn.flag(fn.null_if(tax, 0.0) > 0.04).alias("null_is_zero"),
        fn.map_value(F.col("l_returnflag"), {"R": 3, "A": 2}, 1).alias("flag_weight"),
        fn.rounded(tax / 3).alias("tax_third"),
        fn.at_threshold(discount, 0.05).alias("above_threshold"),
        (quantity * 2).alias("doubled"),
        fn.shift_date(shipped, -90).alias("minus_90_days"),
        fn.shift_date(shipped, 2, "WEEK").alias("plus_2_weeks"),
        fn.shift_date(shipped, -1, "MONTH").alias("minus_1_month"),
        fn.shift_date(shipped, 1, "QUARTER").alias("plus_1_quarter"),
        fn.shift_date(shipped, -1, "YEAR").alias("minus_1_year"),
    )


# --- retail -----------------------------------------------------------------


@query
def extract_orders(data: StarSchema) -> DataFrame:
    return retail.extract_orders(data.raw_orders(), *YEAR)


@query
def extract_returns(data: StarSchema) -> DataFrame:
    return retail.extract_returns(data.raw_returns(), *YEAR)


@query
def extract_inventory(data: StarSchema) -> DataFrame:
    return retail.extract_inventory(data.raw_inventory())


@query
def agg_revenue(data: StarSchema) -> DataFrame:
    return retail.agg_revenue(_all_orders(data))


@query
def agg_price_ratio(data: StarSchema) -> DataFrame:
    """Amounts with endless fractions, added up exactly."""
    ratio = F.col("l_discount") * F.col("l_tax") / 3
    return exact_totals(
        data.table("lineitem"),
        ["l_returnflag", "l_linestatus"],
        sums={"total_ratio": ratio},
        averages={"avg_ratio": ratio},
        counts={"line_count": F.count("*")},
    )


@query
def revenue_ranked(data: StarSchema) -> DataFrame:
    return retail.by_revenue(retail.agg_revenue(_all_orders(data)))


@query
def agg_refunds(data: StarSchema) -> DataFrame:
    return retail.agg_refunds(_all_returns(data), _all_orders(data))


@query
def check_stock(data: StarSchema) -> DataFrame:
    return retail.check_stock(retail.extract_inventory(data.raw_inventory()))


@query
def check_stock_custom_tiers(data: StarSchema) -> DataFrame:
    return retail.check_stock(retail.extract_inventory(data.raw_inventory()), 250, 400)


@query
def build_report(data: StarSchema) -> DataFrame:
    return retail.build_report(
        retail.agg_revenue(_all_orders(data)),
        retail.check_stock(retail.extract_inventory(data.raw_inventory())),
        retail.agg_refunds(_all_returns(data), _all_orders(data)),
    )


@query
def daily_report(data: StarSchema) -> DataFrame:
    return retail.daily_report(
        data.raw_orders(), data.raw_inventory(), data.raw_returns(), FIRST_DAY, LAST_DAY
    )


@query
def daily_report_one_day(data: StarSchema) -> DataFrame:
    orders = data.raw_orders(RUN_DATE, RUN_DATE)
    return retail.daily_report(orders, data.raw_inventory(), data.raw_returns(), RUN_DATE)


# --- features ---------------------------------------------------------------


@query
def user_behavioral(data: StarSchema) -> DataFrame:
    return behavior.user_behavioral(data.table("events"), AS_OF)


@query
def user_behavioral_snapshots(data: StarSchema) -> DataFrame:
    return behavior.user_behavioral(data.table("events"), SNAPSHOTS, session_gap_seconds=1800)


@query
def user_demographic(data: StarSchema) -> DataFrame:
    customers = (
        data.table("customer")
        .join(data.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("n_name").alias("country"),
            F.col("c_acctbal").alias("balance"),
        )
    )
    orders = data.table("orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("order_date")
    )
    return behavior.user_demographic(customers, orders, AGE_DAY, PREMIUM_ABOVE)


@query
def item_engagement(data: StarSchema) -> DataFrame:
    return behavior.item_engagement(data.raw_interactions(), AS_OF)


@query
def item_catalog(data: StarSchema) -> DataFrame:
    return behavior.item_catalog(_catalog_source(data))


@query
def feature_publish_read(data: StarSchema) -> DataFrame:
    root = scratch_path(data.spark, "features")
    features = behavior.user_behavioral(data.table("events"), SNAPSHOTS)
    publish_features(features, root, USER, "behavioral", feature_ts="feature_date")
    return read_features(
        data.spark,
        root,
        USER,
        "behavioral",
        feature_ts="feature_date",
    )


@query
def feature_append_conflict(data: StarSchema) -> DataFrame:
    """Appended rows replace those of the same user and date; the others stay."""
    root = scratch_path(data.spark, "features")
    features = behavior.user_behavioral(data.table("events"), SNAPSHOTS)
    publish_features(features, root, USER, "behavioral", feature_ts="feature_date")
    corrected = features.where(
        (F.col("feature_date") == _day(SNAPSHOTS[1])) & (F.col("user_id") % 2 == 0)
    ).withColumn("support_tickets_90d", F.col("support_tickets_90d") + 100)
    publish_features(
        corrected, root, USER, "behavioral", feature_ts="feature_date", disposition="WRITE_APPEND"
    )
    return read_features(data.spark, root, USER, "behavioral", feature_ts="feature_date")


@query
def feature_truncate(data: StarSchema) -> DataFrame:
    """A truncating run leaves nothing of dates that it lacks."""
    root = scratch_path(data.spark, "features")
    for dates in (SNAPSHOTS, SNAPSHOTS[1:2]):
        features = behavior.user_behavioral(data.table("events"), dates)
        publish_features(features, root, USER, "behavioral", feature_ts="feature_date")
    return read_features(data.spark, root, USER, "behavioral", feature_ts="feature_date")


@query
def feature_publish_churn(data: StarSchema) -> DataFrame:
    root = scratch_path(data.spark, "features")
    raw = churn.churn_training_raw(data.raw_user_events([CHURN_RUN_DATE]), CHURN_RUN_DATE)
    churn.publish_churn_features(churn.churn_features(raw, CHURN_RUN_DATE), root)
    return read_features(data.spark, root, USER, "behavioral", feature_ts="feature_timestamp")


@query
def feature_conform(data: StarSchema) -> DataFrame:
    catalog = behavior.item_catalog(_catalog_source(data)).withColumn("listed_on", _day(AS_OF))
    return conform(catalog, ITEM, ITEM.groups["catalog"], "listed_on")


@query
def feature_violations(data: StarSchema) -> DataFrame:
    """Daily times repeat, some kinds are no integers, most values have a fraction."""
    activity = group("activity", value="INT64", kind="INT64")
    events = data.table("events").select(
        "user_id",
        F.to_date("ts").alias("day"),
        "value",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"),
    )
    return violations(events, Entity("user", "user_id", {"activity": activity}), activity, "day")


@query
def feature_latest(data: StarSchema) -> DataFrame:
    return latest_features(data.table("events"), "user_id", "ts", tie_break=["event_id"])


@query
def feature_view_sync(data: StarSchema) -> DataFrame:
    """The latest rows of all events, by a view synced after each of two publications."""
    events = data.table("events").where(F.col("user_id").isNotNull())
    table, view, checkpoint = (
        scratch_path(data.spark, f"view-{what}") for what in ("table", "rows", "checkpoint")
    )
    late = F.col("ts") < F.lit(HALF_TIME)
    for published in (events.where(~late), events.where(late)):
        # The pair is the time, so that a tie falls as in the batch result.
        timed = published.select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", "value")
        timed.write.mode("append").parquet(table)
        sync_feature_view(data.spark, table, view, checkpoint, "user_id", "at", buckets=16)
    rows = read_feature_view(data.spark, view)
    return rows.select("user_id", "at.ts", "at.event_id", "event_type", "value")


@query
def item_engagement_stream(data: StarSchema) -> DataFrame:
    """Engagement from a stream that sees the older half of the events last."""
    interactions = data.raw_interactions()
    table, view, checkpoint = (
        scratch_path(data.spark, f"engagement-{what}") for what in ("table", "days", "checkpoint")
    )
    late = F.col("ts") < F.lit(HALF_TIME)
    for published in (interactions.where(~late), interactions.where(late)):
        published.write.mode("append").parquet(table)
        stream = data.spark.readStream.schema(interactions.schema).parquet(table)
        sync_item_engagement(data.spark, stream, view, checkpoint, lateness="60 days")
    return read_item_engagement(data.spark, view, AS_OF)


@query
def feature_asof(data: StarSchema) -> DataFrame:
    return asof_features(*_asof_inputs(data), "user_id", "ts", "seen_at")


@query
def feature_asof_split(data: StarSchema) -> DataFrame:
    """The same lookup with most users cut into several ranges."""
    return asof_features(*_asof_inputs(data), "user_id", "ts", "seen_at", parts=200)


# --- churn ------------------------------------------------------------------


@query
def churn_training_raw(data: StarSchema) -> DataFrame:
    return churn.churn_training_raw(data.raw_user_events(SNAPSHOTS), CHURN_RUN_DATE)


@query
def churn_features(data: StarSchema) -> DataFrame:
    return _churn_features(data).withColumn(
        "log_purchases_30d", F.round("log_purchases_30d", 9)
    )


@query
def label_distribution(data: StarSchema) -> DataFrame:
    return churn.label_distribution(_churn_features(data))


@query
def scaled_features(data: StarSchema) -> DataFrame:
    lines = data.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    scaled = scaling.fit_scaler(lines, columns).transform(lines)
    return scaled.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


@query
def churn_scores(data: StarSchema) -> DataFrame:
    return _rounded_scores(_churn_run(data).scores)


@query
def churn_model_reload(data: StarSchema) -> DataFrame:
    """Save, load, and score the saved snapshot with the loaded model."""
    run = _churn_run(data, model_base=scratch_path(data.spark, "models"))
    snapshot = sources.read_parquet(data.spark, f"{run.path}/eval_data")
    return _rounded_scores(churn.score(sources.load_model(run.path), snapshot))


@query
def churn_metrics(data: StarSchema) -> DataFrame:
    return metrics.evaluate(_churn_run(data).scores, metrics.METRICS)


@query
def churn_gate(data: StarSchema) -> DataFrame:
    """The pipeline's gate beside ones that pass and fail."""
    found = metrics.evaluate(_churn_run(data).scores, metrics.METRICS)
    return metrics.gate_report(found, CHURN_GATES)


@query
def binary_metrics(data: StarSchema) -> DataFrame:
    return metrics.evaluate(_quality_scores(data), metrics.METRICS)


@query
def metric_gate(data: StarSchema) -> DataFrame:
    return metrics.gate_report(metrics.evaluate(_quality_scores(data), metrics.METRICS), GATES)


# --- recommendations --------------------------------------------------------


@query
def extract_interactions(data: StarSchema) -> DataFrame:
    return reco.extract_interactions(data.raw_interactions(), HALF_TIME)


@query
def user_item_features(data: StarSchema) -> DataFrame:
    return reco.user_item_features(data.raw_interactions())


@query
def user_profiles(data: StarSchema) -> DataFrame:
    return reco.user_profiles(reco.user_item_features(data.raw_interactions()))


@query
def reco_training_prepared(data: StarSchema) -> DataFrame:
    return reco.training_prepared(data.raw_interactions())


@query
def interaction_matrix(data: StarSchema) -> DataFrame:
    return matrix.interaction_matrix(data.raw_interactions())


@query
def interaction_matrix_wide(data: StarSchema) -> DataFrame:
    return matrix.interaction_matrix_wide(data.raw_interactions(), ITEMS)


@query
def nmf_factors(data: StarSchema) -> DataFrame:
    return _long_factors(reco.train_recommender(data.raw_interactions(), 10, max_iter=10))


@query
def nmf_two_iterations(data: StarSchema) -> DataFrame:
    """Two rounds of descent from starting factors that SQL can state too."""
    scores = matrix.interaction_matrix(data.raw_interactions())
    result = factorize.factorize(
        scores, NMF_RANK, max_iter=2, tol=0.0, init=_starting_factors(scores)
    )
    return _long_factors(result).withColumn("value", F.round("value", 6) + 0.0)


@query
def reco_factors_reload(data: StarSchema) -> DataFrame:
    """Two rounds of descent, stored and read again with what they come from."""
    scores = matrix.interaction_matrix(data.raw_interactions())
    result = factorize.factorize(
        scores, NMF_RANK, max_iter=2, tol=0.0, init=_starting_factors(scores)
    )
    path = sources.save_factors(result, scratch_path(data.spark, "models"), "reco", "r1")
    stored = sources.load_factors(data.spark, path)
    return _long_factors(stored).select(
        "side", "id", "component", (F.round("value", 6) + 0.0).alias("value"),
        F.lit(stored.iterations).alias("iterations"), F.lit(stored.rank).alias("rank"),
    )


@query
def nmf_reconstruction_error(data: StarSchema) -> DataFrame:
    scores = matrix.interaction_matrix(data.raw_interactions())
    error = factorize.reconstruction_error(scores, *_starting_factors(scores), NMF_RANK)
    return error.select(F.round("error", 6).alias("error"))


@query
def ranking_metrics(data: StarSchema) -> DataFrame:
    """First-half interaction scores as recommendations for second-half purchases."""
    seen = data.raw_interactions()
    recommended = matrix.interaction_matrix(seen.where(F.col("ts") < F.lit(HALF_TIME)))
    relevant = seen.where(
        (F.col("ts") >= F.lit(HALF_TIME)) & (F.col("interaction_type") == "purchase")
    )
    return ranking.ranking_metrics(recommended, relevant, k=10)


# --- shared inputs ----------------------------------------------------------


def _day(value: str):
    return F.lit(value).cast("date")


def _accounts(data: StarSchema) -> tuple[DataFrame, DataFrame]:
    return tuple(
        data.table(table).select(
            F.col(f"{prefix}key").alias("account_id"),
            F.col(f"{prefix[0]}_name").alias("account_name"),
            F.col(f"{prefix[0]}_acctbal").alias("balance"),
        )
        for table, prefix in (("customer", "c_cust"), ("supplier", "s_supp"))
    )


def _all_orders(data: StarSchema) -> DataFrame:
    return retail.extract_orders(data.raw_orders(), FIRST_DAY, LAST_DAY)


def _all_returns(data: StarSchema) -> DataFrame:
    return retail.extract_returns(data.raw_returns(), FIRST_DAY, LAST_DAY)


def _catalog_source(data: StarSchema) -> DataFrame:
    return data.table("part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("stock"),
    )


def _asof_inputs(data: StarSchema) -> tuple[DataFrame, DataFrame]:
    events = data.table("events")
    spine = events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", "ts", F.col("value").alias("paid")
    )
    features = events.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("seen_at"), F.col("value").alias("last_view_value")
    )
    return spine, features


def _churn_features(data: StarSchema) -> DataFrame:
    raw = churn.churn_training_raw(data.raw_user_events(SNAPSHOTS), CHURN_RUN_DATE)
    return churn.churn_features(raw, CHURN_RUN_DATE)


def _churn_run(data: StarSchema, **options: object) -> churn.ChurnRun:
    return churn.train_and_gate(
        _churn_features(data), {"auc": 0.0}, invalid="skip", tol=1e-10, **options
    )


def _rounded_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumn("probability", F.round("probability", 3))


def _quality_scores(data: StarSchema) -> DataFrame:
    chars = F.col("n_chars").cast("double")
    return (
        data.table("documents")
        .join(data.table("labels"), "doc_id")
        .select(
            (chars / (chars + 2000.0)).alias("probability"),
            F.col("quality").alias("label"),
        )
    )


def _starting_factors(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    def start(key: str, step: int, shift: int, modulus: int) -> DataFrame:
        factors = [
            ((F.col(key) * step + j * shift) % modulus + 1) / F.lit(float(modulus))
            for j in range(NMF_RANK)
        ]
        return scores.select(key).distinct().select(key, F.array(*factors).alias("factors"))

    return start("user_id", 31, 17, 97), start("item_id", 29, 13, 89)


def _long_factors(result: factorize.Factorization) -> DataFrame:
    sides = [
        table.select(
            F.lit(side).alias("side"),
            F.col(f"{side}_id").alias("id"),
            F.posexplode("factors").alias("component", "value"),
        )
        for side, table in (("user", result.user_factors), ("item", result.item_factors))
    ]
    return sides[0].unionByName(sides[1])
