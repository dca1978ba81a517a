"""The same results in plain SQL, written without looking at the Spark plans.

``raw_*`` common table expressions repeat the mapping of the star-schema tables
to the canonical inputs.
"""

from __future__ import annotations

import re

from tablecraft.sources.star_schema import SCHEMAS
from verification.queries import (
    AGE_DAY,
    AS_OF,
    CHURN_GATES,
    CHURN_RUN_DATE,
    FIRST_DAY,
    GATES,
    HALF_TIME,
    ITEMS,
    LAST_DAY,
    NMF_RANK,
    PREMIUM_ABOVE,
    RUN_DATE,
    SNAPSHOTS,
    YEAR,
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

RAW_ORDERS = """raw_orders AS (
    SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, p.p_type AS category,
           o.o_totalprice AS amount, r.r_name AS region,
           CAST(o.o_orderdate AS DATE) AS order_date
    FROM orders o
    JOIN (SELECT l_orderkey, MIN(l_partkey) AS partkey FROM lineitem GROUP BY l_orderkey) f
      ON f.l_orderkey = o.o_orderkey
    JOIN part p ON p.p_partkey = f.partkey
    JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey
    JOIN region r ON r.r_regionkey = n.n_regionkey)"""

RAW_RETURNS = """raw_returns AS (
    SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS return_id,
           l_orderkey AS order_id, l_linestatus AS reason,
           CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2))
                     * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))
                AS DECIMAL(18,2)) AS DOUBLE) AS refund_amount,
           CAST(l_shipdate AS DATE) AS return_date
    FROM lineitem WHERE l_returnflag = 'R')"""

RAW_INVENTORY = """raw_inventory AS (
    SELECT p_partkey AS item_id, p_type AS category,
           CAST(p_size AS BIGINT) AS stock_count, p_brand AS warehouse
    FROM part)"""

RAW_INTERACTIONS = """raw_interactions AS (
    SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS item_id,
           event_type AS interaction_type, ts
    FROM events)"""


def _total(column: str, bits: int = 64) -> str:
    """The exact sum of doubles that have no bit below 2 ** -bits, as the nearest double."""
    units = f"CAST({column} * {2.0**bits!r} AS HUGEINT)"
    return f"(CAST(CAST(SUM({units}) AS VARCHAR) AS DOUBLE) / {2.0**bits!r})"


def _revenue(source: str) -> str:
    return f"""SELECT category, region, COUNT(*) AS order_count,
           {_total("amount")} AS total_revenue,
           {_total("amount")} / COUNT(amount) AS avg_order_value
    FROM {source} GROUP BY category, region"""


def _refunds(returns: str, orders: str) -> str:
    """Every single return, with the category of its order."""
    return f"""SELECT category, CAST(SUM(times) AS BIGINT) AS refund_count,
           {_total("paid")} AS total_refunds, {_total("paid")} / SUM(valued) AS avg_refund
    FROM (SELECT order_id, 1 AS times, refund_amount AS paid,
                 CASE WHEN refund_amount IS NULL THEN 0 ELSE 1 END AS valued
          FROM {returns}) JOIN {orders} USING (order_id)
    GROUP BY category"""


def _stock(low: int = 10, medium: int = 50) -> str:
    """Levels as a table of lower bounds: the highest one that the stock reaches."""
    return f"""SELECT category, warehouse, total_stock, arg_max(name, bound) AS stock_level
    FROM (SELECT category, warehouse, CAST(SUM(stock_count) AS BIGINT) AS total_stock
          FROM raw_inventory GROUP BY ALL)
    JOIN (VALUES (-9e18::DOUBLE, 'LOW'), ({low}, 'MEDIUM'), ({medium}, 'HIGH')) t(bound, name)
      ON total_stock >= bound
    GROUP BY category, warehouse, total_stock"""


def _report(start: str, end: str) -> str:
    """One long table of facts by category, beside the revenue rows it belongs to."""
    between = f"BETWEEN DATE '{start}' AND DATE '{end}'"
    return f"""WITH {RAW_ORDERS}, {RAW_RETURNS}, {RAW_INVENTORY},
    sold AS (SELECT * FROM raw_orders WHERE order_date {between}),
    fact AS (
        SELECT category, stock_count AS stock, 0 AS times, 0.0::DOUBLE AS paid FROM raw_inventory
        UNION ALL
        SELECT sold.category, 0, 1, refund_amount
        FROM raw_returns JOIN sold USING (order_id) WHERE return_date {between}),
    revenue AS ({_revenue("sold")})
    SELECT revenue.*,
           COALESCE((SELECT CAST(SUM(stock) AS BIGINT) FROM fact
                     WHERE fact.category = revenue.category), 0) AS total_stock,
           COALESCE((SELECT CAST(SUM(times) AS BIGINT) FROM fact
                     WHERE fact.category = revenue.category), 0) AS refund_count,
           COALESCE((SELECT {_total("paid")} FROM fact
                     WHERE fact.category = revenue.category), 0) AS total_refunds
    FROM revenue"""


def _behavioral(dates, gap_seconds: int = 6 * 3600) -> str:
    """CTEs ending in ``behavioral``: sessions by walking every single event."""
    days = ", ".join(f"(DATE '{d}')" for d in dates)
    return f"""snap AS (SELECT * FROM (VALUES {days}) t(feature_date)),
    ev AS (
        SELECT s.feature_date, e.user_id, e.ts, CAST(e.ts AS DATE) AS d, e.event_type, e.value
        FROM events e JOIN snap s
          ON CAST(e.ts AS DATE) <= s.feature_date AND CAST(e.ts AS DATE) > s.feature_date - 90),
    marked AS (
        SELECT *, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER w) < {gap_seconds * 1_000_000}
                       THEN 0 ELSE 1 END AS opens
        FROM ev WINDOW w AS (PARTITION BY feature_date, user_id ORDER BY ts)),
    numbered AS (
        SELECT *, SUM(opens) OVER (PARTITION BY feature_date, user_id ORDER BY ts
                                   ROWS UNBOUNDED PRECEDING) AS session_no
        FROM marked),
    sess AS (
        SELECT feature_date, user_id, session_no, CAST(MIN(ts) AS DATE) AS started_on,
               epoch_us(MAX(ts)) - epoch_us(MIN(ts)) AS us
        FROM numbered GROUP BY feature_date, user_id, session_no),
    per_session AS (
        SELECT feature_date, user_id,
               COUNT(*) FILTER (WHERE started_on > feature_date - 7) AS session_count_7d,
               COUNT(*) FILTER (WHERE started_on > feature_date - 30) AS session_count_30d,
               CAST(SUM(us) FILTER (WHERE started_on > feature_date - 7) AS DOUBLE) / 1000000
                 / NULLIF(COUNT(*) FILTER (WHERE started_on > feature_date - 7), 0)
                 AS avg_session_duration_s
        FROM sess GROUP BY feature_date, user_id),
    per_event AS (
        SELECT feature_date, user_id,
               COALESCE({_total("CASE WHEN event_type = 'purchase' AND d > feature_date - 30 THEN value END")},
                        0.0) AS total_purchases_30d,
               COUNT(*) FILTER (WHERE event_type = 'error') AS support_tickets_90d
        FROM ev GROUP BY feature_date, user_id),
    everyone AS (
        SELECT e.user_id, s.feature_date,
               CAST(s.feature_date - MAX(CAST(e.ts AS DATE)) FILTER (
                   WHERE event_type IN ('view', 'click')) AS BIGINT) AS days_since_last_login
        FROM events e JOIN snap s ON CAST(e.ts AS DATE) <= s.feature_date
        GROUP BY e.user_id, s.feature_date),
    behavioral AS (
        SELECT a.user_id, a.feature_date,
               COALESCE(s.session_count_7d, 0) AS session_count_7d,
               COALESCE(s.session_count_30d, 0) AS session_count_30d,
               COALESCE(e.total_purchases_30d, 0.0) AS total_purchases_30d,
               a.days_since_last_login,
               COALESCE(e.support_tickets_90d, 0) AS support_tickets_90d,
               s.avg_session_duration_s
        FROM everyone a
        LEFT JOIN per_session s ON s.user_id = a.user_id AND s.feature_date = a.feature_date
        LEFT JOIN per_event e ON e.user_id = a.user_id AND e.feature_date = a.feature_date)"""


def _churn_raw() -> str:
    return f"""{_behavioral(SNAPSHOTS)},
    raw_user_events AS (
        SELECT b.*, b.feature_date AS event_date,
               NOT EXISTS (SELECT 1 FROM events p
                           WHERE p.user_id = b.user_id AND p.event_type = 'purchase'
                             AND CAST(p.ts AS DATE) > b.feature_date
                             AND CAST(p.ts AS DATE) <= b.feature_date + 2)
                 AS churned_within_30d
        FROM behavioral b),
    churn_training_raw AS (
        SELECT user_id, session_count_7d, session_count_30d, total_purchases_30d,
               days_since_last_login, support_tickets_90d, avg_session_duration_s,
               CASE WHEN churned_within_30d THEN 1 ELSE 0 END AS label
        FROM raw_user_events
        WHERE event_date BETWEEN DATE '{CHURN_RUN_DATE}' - 90 AND DATE '{CHURN_RUN_DATE}')"""


CHURN_FEATURES = (
    "session_count_7d",
    "session_count_30d",
    "total_purchases_30d",
    "session_trend",
    "log_purchases_30d",
    "days_since_last_login",
    "support_tickets_90d",
    "avg_session_duration_s",
)


def _churn_scores(steps: int = 1500, momentum: float = 0.93) -> str:
    """Logistic regression by accelerated gradient descent in SQL.

    The objective is strictly convex in the weights, so any method that
    converges gives the same probabilities. Features are scaled by the
    population standard deviation; weight ``i`` of the last column is the
    intercept and is not penalised.
    """
    size = len(CHURN_FEATURES)
    every = range(size + 1)
    # The largest curvature of the mean loss is at most a quarter of the squared row norm.
    step = 1.0 / (0.25 * (size + 1) + 0.1)
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - AVG({c}) OVER ()) / NULLIF(STDDEV_POP({c}) OVER (), 0) AS x{i}"
        for i, c in enumerate(CHURN_FEATURES)
    )
    gradient = ", ".join(
        f"y{i} - {step} * (SUM((1 / (1 + EXP(-z)) - label) * x{i}) / COUNT(*)"
        + (f" + y{i} / COUNT(*)" if i < size else "")
        + f") AS w{i}"
        for i in every
    )
    ahead = ", ".join(f"w{i} + {momentum} * (w{i} - p{i}) AS y{i}" for i in every)
    names = ", ".join(f"w{i}" for i in every)
    return f"""{_churn_raw()},
    feats AS (
        SELECT user_id, label, session_count_7d, session_count_30d, total_purchases_30d,
               CAST(session_count_7d AS DOUBLE) / NULLIF(session_count_30d, 0) AS session_trend,
               LN(1 + total_purchases_30d) AS log_purchases_30d,
               days_since_last_login, support_tickets_90d, avg_session_duration_s
        FROM churn_training_raw),
    complete AS (
        SELECT * FROM feats
        WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CHURN_FEATURES)}),
    x AS (SELECT user_id, label, {scaled}, 1.0::DOUBLE AS x{size} FROM complete),
    fit AS (
        SELECT 0 AS step, {", ".join(f"0.0::DOUBLE AS w{i}" for i in every)},
               {", ".join(f"0.0::DOUBLE AS p{i}" for i in every)}
        UNION ALL
        SELECT step + 1, {gradient}, {", ".join(f"w{i} AS p{i}" for i in every)}
        FROM (SELECT l.*, x.*, {" + ".join(f"l.y{i} * x.x{i}" for i in every)} AS z
              FROM (SELECT step, {names}, {ahead} FROM fit WHERE step < {steps}) l, x)
        GROUP BY step, {names}, {", ".join(f"y{i}" for i in every)}),
    churn_scores AS (
        SELECT x.user_id, x.label,
               1 / (1 + EXP(-({" + ".join(f"w{i} * x{i}" for i in every)}))) AS p
        FROM x, (SELECT * FROM fit WHERE step = {steps}))"""


QUALITY_SCORES = """scored AS (
    SELECT CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0) AS p, l.quality AS y
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE l.quality IN (0, 1))"""

# AUC as the share of (positive, negative) pairs in the right order.
METRICS_OF_SCORED = """pairs AS (
        SELECT SUM(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)
               / COUNT(*) AS auc
        FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0),
    counts AS (
        SELECT COUNT(*) FILTER (WHERE p > 0.5 AND y = 1) AS tp,
               COUNT(*) FILTER (WHERE p > 0.5 AND y = 0) AS fp,
               COUNT(*) FILTER (WHERE NOT p > 0.5 AND y = 1) AS fn,
               COUNT(*) AS n
        FROM scored),
    binary_metrics AS (
        SELECT ROUND(CAST((SELECT auc FROM pairs) AS DOUBLE), 4) AS auc,
               ROUND(COALESCE(2.0 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0), 4) AS f1,
               ROUND(COALESCE((n - fp - fn) / NULLIF(CAST(n AS DOUBLE), 0), 0.0), 4) AS accuracy,
               ROUND(COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0), 4) AS precision,
               ROUND(COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0), 4) AS recall
        FROM counts)"""
BINARY_METRICS = f"{QUALITY_SCORES}, {METRICS_OF_SCORED}"

def _starts(key: str, step: int, shift: int, modulus: int) -> str:
    return ", ".join(
        f"(({key} * {step} + {j * shift}) % {modulus} + 1) / {modulus}.0::DOUBLE AS f{j}"
        for j in range(NMF_RANK)
    )


SCORES = f"""{RAW_INTERACTIONS},
    v AS (
        SELECT user_id, item_id,
               SUM(CASE WHEN interaction_type = 'purchase' THEN 3.0 ELSE 1.0 END) AS score
        FROM raw_interactions GROUP BY user_id, item_id),
    w0 AS (SELECT user_id AS id, {_starts("user_id", 31, 17, 97)}
           FROM (SELECT DISTINCT user_id FROM v)),
    h0 AS (SELECT item_id AS id, {_starts("item_id", 29, 13, 89)}
           FROM (SELECT DISTINCT item_id FROM v))"""


def _nmf_step(name: str, old: str, other: str, key: str, other_key: str) -> str:
    """One pass of coordinate descent over the components of a factor."""
    size = range(NMF_RANK)
    sums = ", ".join(f"SUM(v.score * o.f{j}) AS n{j}" for j in size)
    products = ", ".join(f"SUM(f{i} * f{j}) AS g{i}{j}" for i in size for j in size)
    source = f"""(SELECT f.*, n.* EXCLUDE (id), g.*
        FROM {old} f JOIN {name}_num n USING (id), {name}_gram g)"""
    for j in size:
        slope = " + ".join(f"f{i} * g{j}{i}" for i in size) + f" - n{j}"
        moved = f"GREATEST(f{j} - ({slope}) / g{j}{j}, 0)"
        source = f"(SELECT * REPLACE ({moved} AS f{j}) FROM {source})"
    return f"""{name}_num AS (SELECT v.{key} AS id, {sums}
        FROM v JOIN {other} o ON o.id = v.{other_key} GROUP BY v.{key}),
    {name}_gram AS (SELECT {products} FROM {other}),
    {name} AS (SELECT id, {", ".join(f"f{j}" for j in size)} FROM {source})"""


def _long(side: str, factors: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{side}' AS side, id, {j} AS component, ROUND(f{j}, 6) AS value FROM {factors}"
        for j in range(NMF_RANK)
    )


def _two_iterations() -> str:
    return f"""WITH {SCORES},
            {_nmf_step("w1", "w0", "h0", "user_id", "item_id")},
            {_nmf_step("h1", "h0", "w1", "item_id", "user_id")},
            {_nmf_step("w2", "w1", "h1", "user_id", "item_id")},
            {_nmf_step("h2", "h1", "w2", "item_id", "user_id")}
            {_long("user", "w2")} UNION ALL {_long("item", "h2")}"""


def _wide_items() -> str:
    return ",\n           ".join(
        f"COALESCE(SUM(CASE WHEN item_id = {i} THEN score END), 0.0)::DOUBLE AS item_{i}"
        for i in ITEMS
    )


def _gates(limits) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {name} AS value, CAST({limit} AS DOUBLE) AS threshold, "
        f"{name} >= {limit} AS passed FROM binary_metrics"
        for name, limit in limits.items()
    )


def _column_digest(table: str, column: str, kind: str) -> str:
    """Count and MD5 total of a column, values written as text."""

    def text(value: str, kind: str) -> str:
        if kind in ("DOUBLE", "FLOAT"):
            return f"CAST(CAST(round_even({value}::DOUBLE * 10000, 0) AS BIGINT) AS VARCHAR)"
        if kind == "TIMESTAMP_NTZ":
            return f"CAST(epoch_us({value}) AS VARCHAR)"
        if kind.startswith("ARRAY<"):
            inner = text("x", kind[6:-1])
            return f"array_to_string(list_transform({value}, lambda x: coalesce({inner}, 'null')), ',')"
        return f"CAST({value} AS VARCHAR)"

    return f"""SELECT '{table}' AS table_name, '{column}' AS column_name, COUNT(*) AS row_count,
        COUNT({column}) AS value_count,
        coalesce(SUM(CAST('0x' || left(md5({text(column, kind)}), 8) AS BIGINT)), 0)::BIGINT
            AS checksum FROM {table}"""


CHURN_SCORES = f"""WITH RECURSIVE {_churn_scores()}
    SELECT user_id, label, ROUND(p, 3) AS probability,
           CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted FROM churn_scores"""


def _engagement(condition: str = "") -> str:
    return f"""WITH {RAW_INTERACTIONS},
    recent AS (SELECT *, CAST(ts AS DATE) AS d FROM raw_interactions
               WHERE CAST(ts AS DATE) <= DATE '{AS_OF}'
                 AND CAST(ts AS DATE) > DATE '{AS_OF}' - 30 {condition})
    SELECT item_id,
           COUNT(*) FILTER (WHERE interaction_type = 'view'
                              AND d > DATE '{AS_OF}' - 7) AS view_count_7d,
           COUNT(*) FILTER (WHERE interaction_type = 'purchase') AS purchase_count_30d,
           CAST(COUNT(*) FILTER (WHERE interaction_type = 'purchase') AS DOUBLE)
             / NULLIF(COUNT(*) FILTER (WHERE interaction_type = 'view'), 0)
             AS conversion_rate_30d
    FROM recent GROUP BY item_id"""


def oracle_sql() -> dict[str, str]:
    staged = f"""staged_orders AS (SELECT * FROM raw_orders
        WHERE order_date BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}'),
    staged_returns AS (SELECT * FROM raw_returns
        WHERE return_date BETWEEN DATE '{FIRST_DAY}' AND DATE '{LAST_DAY}')"""
    return {
        "csv_scan": "SELECT * FROM orders",
        "parquet_scan": "SELECT * FROM part",
        "load_directory": " UNION ALL ".join(
            _column_digest(table, *column.split())
            for table in TABLES
            for column in re.split(r", (?=\w+ )", SCHEMAS[table])
        ),
        "literal_rows": """SELECT CASE WHEN p_size < 16 THEN 'small' WHEN p_size < 48 THEN 'medium'
            ELSE 'large' END AS level, COUNT(*) AS part_count FROM part GROUP BY level""",
        "stamped_features": f"""WITH {_behavioral([CHURN_RUN_DATE])}
            SELECT user_id, TRUE AS is_later, TRUE AS is_query_start FROM behavioral
            WHERE user_id IS NOT NULL""",
        "balances_presented": """SELECT c_custkey AS account_id, c_acctbal AS balance
            FROM customer ORDER BY balance DESC, account_id LIMIT 25""",
        "run_discarded": "SELECT c_custkey AS account_id, c_acctbal AS balance FROM customer",
        "stage_files": "SELECT * FROM customer",
        "write_dispositions": _accounts(),
        "union_all": _accounts(),
        "query_extract": f"WITH {RAW_INVENTORY} SELECT * FROM raw_inventory",
        "custom_sql": f"""
            SELECT o_orderpriority, COUNT(*) AS order_count,
                   CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)
                     / NULLIF(COUNT(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS filled_to_open
            FROM orders
            WHERE o_orderdate >= DATE '{YEAR[0]}' - INTERVAL 90 DAY
            GROUP BY o_orderpriority""",
        "scalar_functions": """
            SELECT l_orderkey, l_partkey, l_linenumber,
                   CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END
                     AS tax_per_discount,
                   NULLIF(l_tax, 0.0) AS tax_or_null,
                   COALESCE(NULLIF(l_tax, 0.0), 0) AS tax_or_zero,
                   ROUND(LN(1 + l_quantity), 9) AS log_quantity,
                   CASE WHEN l_linenumber < 2 THEN ROUND(LN(2.0 - l_linenumber), 9) END
                     AS log_outside_domain,
                   CAST(l_linenumber AS DOUBLE) AS linenumber_double,
                   CASE WHEN l_quantity < 10 THEN 'LOW' WHEN l_quantity < 50 THEN 'MEDIUM'
                        ELSE 'HIGH' END AS quantity_tier,
                   CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_returned,
                   CASE WHEN NULLIF(l_tax, 0.0) > 0.04 THEN 1 ELSE 0 END AS null_is_zero,
                   CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS flag_weight,
                   ROUND(l_tax / 3, 4) AS tax_third,
                   CASE WHEN l_discount > CAST(0.05 AS DOUBLE) THEN 1 ELSE 0 END
                     AS above_threshold,
                   l_quantity * 2 AS doubled,
                   CAST(CAST(l_shipdate AS DATE) - INTERVAL 90 DAY AS DATE) AS minus_90_days,
                   CAST(CAST(l_shipdate AS DATE) + INTERVAL 14 DAY AS DATE) AS plus_2_weeks,
                   CAST(CAST(l_shipdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS minus_1_month,
                   CAST(CAST(l_shipdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS plus_1_quarter,
                   CAST(CAST(l_shipdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS minus_1_year
            FROM lineitem""",
        "extract_orders": f"""WITH {RAW_ORDERS} SELECT * FROM raw_orders
            WHERE order_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'""",
        "extract_returns": f"""WITH {RAW_RETURNS} SELECT * FROM raw_returns
            WHERE return_date BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'""",
        "extract_inventory": f"WITH {RAW_INVENTORY} SELECT * FROM raw_inventory",
        "agg_price_ratio": f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS line_count,
            {_total("ratio", 80)} AS total_ratio, {_total("ratio", 80)} / COUNT(ratio) AS avg_ratio
            FROM (SELECT *, l_discount * l_tax / 3 AS ratio FROM lineitem) GROUP BY ALL""",
        "agg_revenue": f"WITH {RAW_ORDERS} {_revenue('raw_orders')}",
        "revenue_ranked": f"WITH {RAW_ORDERS} {_revenue('raw_orders')} ORDER BY total_revenue DESC",
        "agg_refunds": f"""WITH {RAW_ORDERS}, {RAW_RETURNS}, {staged}
            {_refunds("staged_returns", "staged_orders")}""",
        "check_stock": f"WITH {RAW_INVENTORY} {_stock()}",
        "check_stock_custom_tiers": f"WITH {RAW_INVENTORY} {_stock(250, 400)}",
        "build_report": _report(FIRST_DAY, LAST_DAY),
        "daily_report": _report(FIRST_DAY, LAST_DAY),
        "daily_report_one_day": _report(RUN_DATE, RUN_DATE),
        "user_behavioral": f"WITH {_behavioral([AS_OF])} SELECT * FROM behavioral",
        "user_behavioral_snapshots": f"""WITH {_behavioral(SNAPSHOTS, 1800)}
            SELECT * FROM behavioral""",
        "user_demographic": f"""
            SELECT c.c_custkey AS user_id, n.n_name AS country,
                   CAST(DATE '{AGE_DAY}' - CAST(f.since AS DATE) AS BIGINT) AS account_age_days,
                   c.c_acctbal > {PREMIUM_ABOVE} AS is_premium
            FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
            LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS since FROM orders
                       GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey""",
        "item_engagement": _engagement(),
        "item_engagement_stream": _engagement("AND item_id IS NOT NULL"),
        "item_catalog": """
            SELECT p_partkey AS item_id, p_type AS category, p_retailprice AS price_usd,
                   CAST(p_size AS BIGINT) AS stock_count FROM part""",
        "feature_publish_read": f"""WITH {_behavioral(SNAPSHOTS)}
            SELECT CAST(user_id AS VARCHAR) AS user_id, feature_date, session_count_7d,
                   session_count_30d, total_purchases_30d, days_since_last_login,
                   support_tickets_90d, avg_session_duration_s FROM behavioral""",
        "feature_append_conflict": f"""WITH {_behavioral(SNAPSHOTS)}
            SELECT CAST(user_id AS VARCHAR) AS user_id, feature_date, session_count_7d,
                   session_count_30d, total_purchases_30d, days_since_last_login,
                   support_tickets_90d + CASE WHEN user_id % 2 = 0
                       AND feature_date = DATE '{SNAPSHOTS[1]}' THEN 100 ELSE 0 END
                       AS support_tickets_90d,
                   avg_session_duration_s FROM behavioral""",
        "feature_truncate": f"""WITH {_behavioral(SNAPSHOTS[1:2])}
            SELECT CAST(user_id AS VARCHAR) AS user_id, feature_date, session_count_7d,
                   session_count_30d, total_purchases_30d, days_since_last_login,
                   support_tickets_90d, avg_session_duration_s FROM behavioral""",
        "feature_publish_churn": f"""WITH {_behavioral([CHURN_RUN_DATE])}
            SELECT CAST(user_id AS VARCHAR) AS user_id,
                   CAST('{CHURN_RUN_DATE}' AS TIMESTAMP) AS feature_timestamp, session_count_7d,
                   session_count_30d, total_purchases_30d, days_since_last_login,
                   support_tickets_90d, avg_session_duration_s
            FROM behavioral WHERE user_id IS NOT NULL""",
        "feature_conform": f"""
            SELECT CAST(p_partkey AS VARCHAR) AS item_id, DATE '{AS_OF}' AS listed_on,
                   p_type AS category, p_retailprice AS price_usd,
                   CAST(p_size AS BIGINT) AS stock_count FROM part""",
        "feature_violations": """
            SELECT COUNT(*) AS row_count,
                   COUNT(*) FILTER (WHERE user_id IS NULL) AS null_ids,
                   COUNT(*) FILTER (WHERE ts IS NULL) AS null_times,
                   (SELECT COUNT(*) FROM (
                        SELECT user_id, CAST(ts AS DATE) FROM events
                        WHERE user_id IS NOT NULL AND ts IS NOT NULL
                        GROUP BY 1, 2 HAVING COUNT(*) > 1)) AS duplicate_keys,
                   COUNT(*) FILTER (WHERE value <> trunc(value) OR (event_id % 3 = 0
                       AND event_type IS NOT NULL
                       AND TRY_CAST(event_type AS BIGINT) IS NULL)) AS bad_values
            FROM events""",
        "feature_latest": """
            SELECT event_id, ts, user_id, event_type, value, props FROM (
                SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
                              ORDER BY ts DESC, event_id DESC) AS newest FROM events)
            WHERE newest = 1""",
        "feature_view_sync": """
            SELECT user_id, ts, event_id, event_type, value FROM (
                SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
                              ORDER BY ts DESC, event_id DESC) AS newest FROM events)
            WHERE newest = 1 AND user_id IS NOT NULL""",
        "feature_asof": ASOF,
        "feature_asof_split": ASOF,
        "churn_training_raw": f"WITH {_churn_raw()} SELECT * FROM churn_training_raw",
        "churn_features": f"""WITH {_churn_raw()}
            SELECT user_id, session_count_7d, session_count_30d, total_purchases_30d,
                   CAST(session_count_7d AS DOUBLE) / NULLIF(session_count_30d, 0)
                     AS session_trend,
                   ROUND(LN(1 + total_purchases_30d), 9) AS log_purchases_30d,
                   days_since_last_login, support_tickets_90d, avg_session_duration_s, label,
                   CAST('{CHURN_RUN_DATE}' AS TIMESTAMP) AS feature_timestamp
            FROM churn_training_raw WHERE user_id IS NOT NULL""",
        "label_distribution": f"""WITH {_churn_raw()}
            SELECT label, COUNT(*) AS row_count FROM churn_training_raw
            WHERE user_id IS NOT NULL GROUP BY label""",
        "churn_scores": CHURN_SCORES,
        "churn_model_reload": CHURN_SCORES,
        "churn_metrics": f"""WITH RECURSIVE {_churn_scores()},
            scored AS (SELECT p, label AS y FROM churn_scores), {METRICS_OF_SCORED}
            SELECT * FROM binary_metrics""",
        "churn_gate": f"""WITH RECURSIVE {_churn_scores()},
            scored AS (SELECT p, label AS y FROM churn_scores), {METRICS_OF_SCORED}
            {_gates(CHURN_GATES)}""",
        "scaled_features": "WITH s AS (SELECT "
        + ", ".join(
            f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        )
        + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
        + ", ".join(
            f"ROUND(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}"
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
        )
        + " FROM lineitem, s",
        "binary_metrics": f"WITH {BINARY_METRICS} SELECT * FROM binary_metrics",
        "metric_gate": f"WITH {BINARY_METRICS} {_gates(GATES)}",
        "extract_interactions": f"""WITH {RAW_INTERACTIONS} SELECT * FROM raw_interactions
            WHERE ts >= TIMESTAMP '{HALF_TIME}'""",
        "user_item_features": f"""WITH {RAW_INTERACTIONS}
            SELECT user_id, item_id, interaction_type, COUNT(*) AS interaction_count
            FROM raw_interactions GROUP BY user_id, item_id, interaction_type""",
        "user_profiles": f"""WITH {RAW_INTERACTIONS}
            SELECT user_id, COUNT(DISTINCT item_id) AS unique_items,
                   COUNT(*) AS total_interactions,
                   COUNT(*) FILTER (WHERE interaction_type = 'purchase') AS purchase_count
            FROM raw_interactions GROUP BY user_id""",
        "reco_training_prepared": f"WITH {RAW_INTERACTIONS} SELECT * FROM raw_interactions",
        "interaction_matrix": f"""WITH {SCORES}
            SELECT user_id, item_id, CAST(score AS DOUBLE) AS score FROM v""",
        "interaction_matrix_wide": f"""WITH {SCORES}
            SELECT user_id, {_wide_items()} FROM v GROUP BY user_id""",
        "reco_factors_reload": f"""SELECT *, 2 AS iterations, {NMF_RANK} AS rank
            FROM ({_two_iterations()})""",
        "nmf_two_iterations": _two_iterations(),
        "nmf_reconstruction_error": f"""WITH {SCORES},
            dense AS (SELECT w0.id AS user_id, h0.id AS item_id,
                             {" + ".join(f"w0.f{j} * h0.f{j}" for j in range(NMF_RANK))} AS wh
                      FROM w0, h0)
            SELECT ROUND(SQRT(SUM(POWER(COALESCE(v.score, 0) - d.wh, 2))), 6) AS error
            FROM dense d LEFT JOIN v ON v.user_id = d.user_id AND v.item_id = d.item_id""",
        "ranking_metrics": f"""WITH {RAW_INTERACTIONS},
            rec AS (
                SELECT user_id, item_id, ROW_NUMBER() OVER (PARTITION BY user_id
                           ORDER BY score DESC, item_id) AS rnk
                FROM (SELECT user_id, item_id,
                             SUM(CASE WHEN interaction_type = 'purchase' THEN 3 ELSE 1 END)
                               AS score
                      FROM raw_interactions WHERE ts < TIMESTAMP '{HALF_TIME}'
                      GROUP BY user_id, item_id)),
            truth AS (SELECT DISTINCT user_id, item_id FROM raw_interactions
                      WHERE ts >= TIMESTAMP '{HALF_TIME}' AND interaction_type = 'purchase'),
            wanted AS (SELECT user_id, COUNT(*) AS n FROM truth GROUP BY user_id),
            hits AS (
                SELECT t.user_id, r.rnk, ROW_NUMBER() OVER (PARTITION BY t.user_id
                           ORDER BY r.rnk) AS hit_no
                FROM truth t JOIN rec r ON r.user_id = t.user_id AND r.item_id = t.item_id
                WHERE r.rnk <= 10),
            gained AS (SELECT user_id, SUM(1.0::DOUBLE / LOG2(rnk + 1.0)) AS dcg,
                              SUM(hit_no / CAST(rnk AS DOUBLE)) AS ps
                       FROM hits GROUP BY user_id),
            per_user AS (
                SELECT w.user_id,
                       COALESCE(g.dcg, 0.0) / (SELECT SUM(1.0::DOUBLE / LOG2(range + 1.0))
                                               FROM range(1, LEAST(w.n, 10) + 1)) AS ndcg,
                       COALESCE(g.ps, 0.0) / LEAST(w.n, 10) AS ap
                FROM wanted w LEFT JOIN gained g ON g.user_id = w.user_id)
            SELECT COUNT(*) AS users, ROUND(AVG(ndcg), 6) AS ndcg_at_k,
                   ROUND(AVG(ap), 6) AS map_at_k FROM per_user""",
    }


ASOF = """
    SELECT s.event_id, s.user_id, s.ts, s.value AS paid, f.ts AS seen_at,
           f.value AS last_view_value
    FROM (SELECT * FROM events WHERE event_type = 'purchase') s
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') f
      ON f.user_id = s.user_id AND f.ts <= s.ts"""


def _accounts() -> str:
    return """SELECT c_custkey AS account_id, c_name AS account_name, c_acctbal AS balance
    FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier"""
