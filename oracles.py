"""DuckDB SQL equivalents of the registered queries, written from the definitions."""

from __future__ import annotations

from valuegrain.operators.audience import CAMPAIGNS, LOOKALIKES, TARGETING
from valuegrain.operators.calendar import HOLIDAYS
from valuegrain.operators.catalogue import CATALOGUE
from valuegrain.plans.queries import BUDGET, EXPORT_DATE

DAY = "strftime({0}, '%Y-%m-%d') AS {0}"


def _customers(cutoff: str | None = None, unit: float = 5000.0) -> str:
    """The customer table as a chain of common table expressions ending in ``base``."""
    seen = f"WHERE day < DATE '{cutoff}'" if cutoff else ""
    snapshot = f"DATE '{cutoff}'" if cutoff else "(SELECT max(day) FROM all_orders)"
    email = "" if cutoff else "e.email_engagement_rate,"
    target = f", lt.cents / {100 * unit!r} AS actual_clv" if cutoff else ""
    return f"""
all_orders AS (
  SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders),
seen_orders AS (SELECT * FROM all_orders {seen}),
per_customer AS (
  SELECT o_custkey, count(*) AS n, CAST(sum(cents) AS DOUBLE) AS cents,
         min(day) AS f, max(day) AS l
  FROM seen_orders GROUP BY o_custkey),
lifetime AS (
  SELECT o_custkey, CAST(sum(cents) AS DOUBLE) AS cents FROM all_orders GROUP BY o_custkey),
first_order AS (
  SELECT o_custkey, o_orderpriority FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) AS rn
    FROM seen_orders) WHERE rn = 1),
line_rows AS (
  SELECT o_custkey, l_returnflag, p_type
  FROM lineitem JOIN seen_orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey),
per_line AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS return_rate,
         string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS product_categories,
         CAST(count(DISTINCT p_type) AS INTEGER) AS num_categories
  FROM line_rows GROUP BY o_custkey),
per_event AS (
  SELECT user_id,
         count(*) FILTER (WHERE event_type IN ('click', 'purchase'))
           / CAST(count(*) AS DOUBLE) AS email_engagement_rate
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
named AS (
  SELECT c.*, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Meta Ads'
         WHEN 'BUILDING' THEN 'Google Ads' WHEN 'FURNITURE' THEN 'Email'
         WHEN 'HOUSEHOLD' THEN 'Organic' WHEN 'MACHINERY' THEN 'Referral'
         ELSE 'Direct' END AS source FROM customer c),
base AS (
  SELECT 'CUST_' || lpad(CAST(c.c_custkey AS VARCHAR), 12, '0') AS customer_id,
         p.f AS first_purchase_date, p.l AS last_purchase_date, p.n AS total_orders,
         p.cents / {100 * unit!r} AS total_spent,
         p.cents / {100 * unit!r} / p.n AS avg_order_value,
         CAST(date_diff('day', p.f, {snapshot}) AS INTEGER) AS days_since_first_purchase,
         CAST(date_diff('day', p.l, {snapshot}) AS INTEGER) AS days_since_last_purchase,
         li.product_categories, li.num_categories, c.source AS acquisition_source,
         CASE WHEN c.source NOT IN ('Meta Ads', 'Google Ads') THEN 'None'
              WHEN fo.o_orderpriority = '1-URGENT' THEN 'Retargeting'
              WHEN fo.o_orderpriority = '2-HIGH' THEN 'Brand'
              ELSE 'Prospecting' END AS campaign_type,
         greatest(c.c_acctbal, 0.0) / 100.0 AS acquisition_cost,
         {email} li.return_rate {target}
  FROM per_customer p JOIN named c ON c.c_custkey = p.o_custkey
  JOIN first_order fo ON fo.o_custkey = p.o_custkey
  JOIN lifetime lt ON lt.o_custkey = p.o_custkey
  LEFT JOIN per_line li ON li.o_custkey = p.o_custkey
  LEFT JOIN per_event e ON e.user_id = p.o_custkey)"""


def _tail(column: str) -> str:
    low = f"(SELECT quantile_cont({column}, 0.01) FROM filled)"
    high = f"(SELECT quantile_cont({column}, 0.99) FROM filled)"
    return (
        f"least(greatest({column}, greatest(0, {low} - 1.5 * ({high} - {low}))), "
        f"{high} + 1.5 * ({high} - {low})) AS {column}"
    )


CLIPPED = f"""
clean AS (
  SELECT * REPLACE (
    {_tail('total_spent')}, {_tail('avg_order_value')},
    greatest(total_orders, 0) AS total_orders,
    greatest(days_since_first_purchase, 0) AS days_since_first_purchase,
    greatest(days_since_last_purchase, 0) AS days_since_last_purchase,
    least(greatest(email_engagement_rate, 0.0), 1.0) AS email_engagement_rate,
    least(greatest(return_rate, 0.0), 1.0) AS return_rate)
  FROM filled)"""

CLEAN = f"""
filled AS (
  SELECT * REPLACE (
    coalesce(email_engagement_rate, (SELECT median(email_engagement_rate) FROM base))
      AS email_engagement_rate,
    coalesce(return_rate, (SELECT median(return_rate) FROM base)) AS return_rate)
  FROM base),
{CLIPPED}"""

NUMBER = "CAST(substr(customer_id, 6, 12) AS BIGINT)"
GAPPED = f"""
gapped AS (
  SELECT * REPLACE (
    CASE WHEN {NUMBER} % 7 <> 0 THEN acquisition_source END AS acquisition_source,
    CASE WHEN {NUMBER} % 11 <> 0 THEN campaign_type END AS campaign_type,
    CASE WHEN {NUMBER} % 13 <> 0 THEN total_spent END AS total_spent,
    CASE WHEN {NUMBER} % 5 = 0 THEN 0.0::DOUBLE ELSE avg_order_value END AS avg_order_value,
    CASE WHEN {NUMBER} % 17 = 0 THEN -days_since_last_purchase
         ELSE days_since_last_purchase END AS days_since_last_purchase,
    CASE WHEN {NUMBER} % 29 = 0 THEN -total_orders ELSE total_orders END AS total_orders,
    CASE WHEN {NUMBER} % 19 = 0 THEN return_rate + 1.5::DOUBLE
         ELSE return_rate END AS return_rate,
    CASE WHEN {NUMBER} % 23 = 0 THEN email_engagement_rate - 1.5::DOUBLE
         ELSE email_engagement_rate END AS email_engagement_rate)
  FROM base)"""


def _most_frequent(column: str) -> str:
    return (
        f"coalesce({column}, (SELECT {column} FROM gapped WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)) AS {column}"
    )


CLEAN_GAPPED = f"""
filled AS (
  SELECT * REPLACE (
    {_most_frequent('acquisition_source')}, {_most_frequent('campaign_type')},
    coalesce(total_spent, (SELECT median(total_spent) FROM gapped)) AS total_spent,
    coalesce(email_engagement_rate, (SELECT median(email_engagement_rate) FROM gapped))
      AS email_engagement_rate,
    coalesce(return_rate, (SELECT median(return_rate) FROM gapped)) AS return_rate)
  FROM gapped),
{CLIPPED}"""

STATS = """
st AS (
  SELECT count(*) AS n, max(days_since_last_purchase) AS max_r, max(total_orders) AS max_f,
         max(total_spent) AS max_m, median(avg_order_value) AS med_aov,
         median(total_spent) AS med_spent, quantile_cont(avg_order_value, 0.75) AS aov75,
         quantile_cont(avg_order_value, 0.9) AS aov90,
         avg(days_since_last_purchase) AS mean_r, stddev_samp(days_since_last_purchase) AS sd_r,
         avg(total_spent) AS mean_spent, stddev_samp(total_spent) AS sd_spent,
         avg(total_orders) AS mean_orders, stddev_samp(total_orders) AS sd_orders,
         avg(avg_order_value) AS mean_aov, stddev_samp(avg_order_value) AS sd_aov
  FROM clean)"""


def _bin(column: str) -> str:
    rank = f"row_number() OVER (ORDER BY {column}, customer_id)"
    return f"greatest(1, ((({rank}) - 1) * 5 + st.n - 2) // (st.n - 1))"


SEGMENT_RULES = """
CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions'
     WHEN f >= 4 AND m >= 4 THEN 'Loyal Customers'
     WHEN r >= 4 AND f >= 3 THEN 'Potential Loyalists'
     WHEN r >= 4 AND f <= 2 THEN 'Recent Customers'
     WHEN r >= 3 AND f >= 2 AND m >= 2 THEN 'Promising'
     WHEN r >= 2 AND f >= 3 AND m >= 3 THEN 'Need Attention'
     WHEN r <= 2 AND f >= 2 THEN 'About to Sleep'
     WHEN r <= 2 AND f <= 2 THEN 'Hibernating' ELSE 'Others' END"""

QUANTILE_TRIPLE = f"""
triple AS (
  SELECT customer_id, CAST(6 - {_bin('days_since_last_purchase')} AS DOUBLE) AS r,
         CAST({_bin('total_orders')} AS DOUBLE) AS f,
         CAST({_bin('total_spent')} AS DOUBLE) AS m
  FROM clean, st)"""

FIXED_TRIPLE = """
triple AS (
  SELECT customer_id,
         CAST(CASE WHEN days_since_last_purchase <= 7 THEN 5
              WHEN days_since_last_purchase <= 30 THEN 4
              WHEN days_since_last_purchase <= 90 THEN 3
              WHEN days_since_last_purchase <= 180 THEN 2 ELSE 1 END AS DOUBLE) AS r,
         CAST(CASE WHEN total_orders <= 1 THEN 1 WHEN total_orders <= 3 THEN 2
              WHEN total_orders <= 6 THEN 3 WHEN total_orders <= 12 THEN 4 ELSE 5 END
              AS DOUBLE) AS f,
         CAST(CASE WHEN total_spent <= 50 THEN 1 WHEN total_spent <= 150 THEN 2
              WHEN total_spent <= 400 THEN 3 WHEN total_spent <= 1000 THEN 4 ELSE 5 END
              AS DOUBLE) AS m
  FROM clean)"""

RFM = f"""
rfm AS (
  SELECT c.customer_id, r AS recency_score,
         CAST(1 - days_since_last_purchase / CAST(max_r AS DOUBLE) AS DOUBLE)
           AS recency_normalized,
         f AS frequency_score, ln(1 + total_orders) AS frequency_log,
         total_orders / CAST(max_f AS DOUBLE) AS frequency_normalized, m AS monetary_score,
         ln(1 + total_spent) AS monetary_log, total_spent / max_m AS monetary_normalized,
         r + f + m AS rfm_score, r * 0.2 + f * 0.35 + m * 0.45 AS rfm_weighted,
         CAST(CAST(r AS INTEGER) AS VARCHAR) || CAST(CAST(f AS INTEGER) AS VARCHAR)
           || CAST(CAST(m AS INTEGER) AS VARCHAR) AS rfm_string,
         {SEGMENT_RULES} AS rfm_segment
  FROM clean c JOIN triple t ON t.customer_id = c.customer_id, st)"""

BEHAVIOR = """
behavior AS (
  SELECT *, CASE WHEN avg_days_between_purchases > 0
                 THEN 1 / (1 + avg_days_between_purchases / 30.0) ELSE 0.0 END
              AS purchase_regularity,
         CASE WHEN churn_risk_score >= 2 THEN 1 ELSE 0 END AS is_at_risk
  FROM (
    SELECT customer_id,
      total_orders / greatest(d / 30.44, 0.5) AS purchase_velocity,
      total_orders / greatest(d / 7.0, 1.0) AS orders_per_week,
      CASE WHEN d > 0 THEN 1 - days_since_last_purchase / d ELSE 0.0 END AS recency_ratio,
      CASE WHEN total_orders > 1 THEN d / (total_orders - 1) ELSE d END
        AS avg_days_between_purchases,
      total_spent / greatest(d / 30.44, 0.5) AS spending_velocity,
      abs(avg_order_value - med_aov) / med_aov AS aov_deviation,
      CAST(CASE WHEN email_engagement_rate <= 0 THEN 0 WHEN email_engagement_rate <= 0.2 THEN 1
           WHEN email_engagement_rate <= 0.4 THEN 2 WHEN email_engagement_rate <= 0.6 THEN 3
           WHEN email_engagement_rate <= 0.8 THEN 4 WHEN email_engagement_rate <= 1 THEN 5
           ELSE 0 END AS DOUBLE) AS email_engagement_bucket,
      CASE WHEN return_rate > 0.1 THEN 1 ELSE 0 END AS is_returner,
      CASE WHEN return_rate > 0.3 THEN 2 WHEN return_rate > 0.15 THEN 1 ELSE 0 END
        AS return_risk,
      email_engagement_rate * 0.6 + (1 - return_rate) * 0.4 AS engagement_score,
      days_since_first_purchase AS tenure_days, d / 30.44 AS tenure_months,
      d / 365.25 AS tenure_years,
      CAST(CASE WHEN d <= 0 THEN 0 WHEN d <= 30 THEN 1 WHEN d <= 90 THEN 2 WHEN d <= 180 THEN 3
           WHEN d <= 365 THEN 4 WHEN d <= 730 THEN 5 ELSE 6 END AS DOUBLE) AS tenure_bucket,
      least(d / 365.0, 1.0) AS customer_maturity,
      CASE WHEN num_categories >= 3 THEN 1 ELSE 0 END AS is_multi_category,
      least(num_categories / CAST(5 AS DOUBLE), 1.0) AS category_diversity,
      CASE WHEN avg_order_value >= aov75 THEN 1 ELSE 0 END AS is_high_aov,
      CASE WHEN avg_order_value >= aov90 THEN 1 ELSE 0 END AS is_premium,
      CASE WHEN days_since_last_purchase > mean_r + 2 * sd_r THEN 3
           WHEN days_since_last_purchase > mean_r + sd_r THEN 2
           WHEN days_since_last_purchase > mean_r THEN 1 ELSE 0 END AS churn_risk_score
    FROM (SELECT *, CAST(days_since_first_purchase AS DOUBLE) AS d FROM clean), st))"""


def _calendar(side: str) -> str:
    day = f"{side}_purchase_date"
    return f"""
      CAST(isodow({day}) - 1 AS INTEGER) AS {side}_purchase_dow,
      CAST(month({day}) AS INTEGER) AS {side}_purchase_month,
      CAST(quarter({day}) AS INTEGER) AS {side}_purchase_quarter,
      CASE WHEN isodow({day}) >= 6 THEN 1 ELSE 0 END AS {side}_purchase_is_weekend"""


TEMPORAL = f"""
temporal AS (
  SELECT customer_id, {_calendar('first')},
      CASE WHEN month(first_purchase_date) IN (12, 1, 2) THEN 1
           WHEN month(first_purchase_date) IN (3, 4, 5) THEN 2
           WHEN month(first_purchase_date) IN (6, 7, 8) THEN 3 ELSE 4 END
        AS first_purchase_season, {_calendar('last')},
      CASE WHEN days_since_last_purchase <= 7 THEN 1 ELSE 0 END AS purchased_last_7d,
      CASE WHEN days_since_last_purchase <= 30 THEN 1 ELSE 0 END AS purchased_last_30d,
      CASE WHEN days_since_last_purchase <= 90 THEN 1 ELSE 0 END AS purchased_last_90d,
      CASE WHEN days_since_last_purchase > 180 THEN 1 ELSE 0 END AS inactive_180d
  FROM clean)"""

Z_COLUMNS = (
    ("total_spent", "mean_spent", "sd_spent"),
    ("total_orders", "mean_orders", "sd_orders"),
    ("avg_order_value", "mean_aov", "sd_aov"),
)
STATISTICAL = (
    "statistical AS (SELECT *, "
    + " + ".join(f"{c}_is_outlier" for c, _, _ in Z_COLUMNS)
    + " AS outlier_score FROM (SELECT customer_id, "
    + ", ".join(
        f"({c} - {mean}) / {sd} AS {c}_zscore, "
        f"(rank() OVER (ORDER BY {c}) - 1 "
        f"+ (count(*) OVER (PARTITION BY {c}) + 1) / CAST(2 AS DOUBLE)) / n AS {c}_percentile, "
        f"CASE WHEN abs(({c} - {mean}) / {sd}) > 3 THEN 1 ELSE 0 END AS {c}_is_outlier"
        for c, mean, sd in Z_COLUMNS
    )
    + " FROM clean, st))"
)

ACQUISITION = """
acquisition AS (
  SELECT customer_id,
      CAST(CASE acquisition_source WHEN 'Referral' THEN 0.95 WHEN 'Email' THEN 0.85
           WHEN 'Organic' THEN 0.80 WHEN 'Google Ads' THEN 0.75 WHEN 'Meta Ads' THEN 0.70
           WHEN 'Direct' THEN 0.65 ELSE 0.5 END AS DOUBLE) AS source_quality_score,
      CASE WHEN acquisition_source IN ('Meta Ads', 'Google Ads') THEN 1 ELSE 0 END
        AS is_paid_acquisition,
      CASE WHEN acquisition_source IN ('Organic', 'Direct', 'Referral') THEN 1 ELSE 0 END
        AS is_organic,
      CASE WHEN acquisition_source = 'Referral' THEN 1 ELSE 0 END AS is_referral,
      CAST(CASE campaign_type WHEN 'Retargeting' THEN 0.85 WHEN 'Brand' THEN 0.75
           WHEN 'Prospecting' THEN 0.65 ELSE 0.5 END AS DOUBLE) AS campaign_effectiveness,
      CASE WHEN campaign_type = 'Retargeting' THEN 1 ELSE 0 END AS is_retargeted,
      CASE WHEN campaign_type = 'Prospecting' THEN 1 ELSE 0 END AS is_prospecting,
      CASE WHEN acquisition_cost > 0 THEN 1 ELSE 0 END AS has_cac,
      CASE WHEN acquisition_cost > 0 THEN total_spent / acquisition_cost ELSE med_spent END
        AS cac_efficiency,
      CASE WHEN acquisition_cost > 0
           THEN (total_spent - acquisition_cost) / acquisition_cost ELSE 0.0 END AS cac_roi,
      CASE WHEN total_spent > acquisition_cost THEN 1 ELSE 0 END AS cac_paid_back
  FROM clean, st)"""

PARTS = ("rfm_weighted", "engagement_score", "purchase_velocity", "cac_efficiency")
INTERACTION = (
    """
joined AS (
  SELECT c.*, r.* EXCLUDE (customer_id), b.* EXCLUDE (customer_id),
         t.* EXCLUDE (customer_id), a.* EXCLUDE (customer_id)
  FROM clean c JOIN rfm r USING (customer_id) JOIN behavior b USING (customer_id)
  JOIN temporal t USING (customer_id) JOIN acquisition a USING (customer_id)),
spans AS (SELECT """
    + ", ".join(f"min({p}) AS lo_{p}, max({p}) AS hi_{p}" for p in PARTS)
    + """ FROM joined),
interaction AS (
  SELECT customer_id,
      avg_order_value / med_aov * ln(1 + total_orders) AS value_frequency_score,
      engagement_score * monetary_normalized AS engaged_value_score,
      recency_normalized * frequency_normalized AS rf_score,
      customer_maturity * monetary_normalized AS mature_value_score,
      source_quality_score * monetary_normalized AS source_value_score,
      ("""
    + " + ".join(f"({p} - lo_{p}) / (hi_{p} - lo_{p} + 1e-10)" for p in PARTS)
    + """) / 4 AS clv_predictor_composite,
      source_numeric, source_numeric * num_categories AS source_category_interaction,
      campaign_numeric, campaign_numeric * (total_spent / med_spent)
        AS campaign_value_interaction,
      first_purchase_quarter * ln(1 + total_orders) AS quarter_frequency_interaction,
      first_purchase_season * (avg_order_value / med_aov) AS season_value_interaction,
      email_engagement_rate * (1 - days_since_last_purchase / CAST(max_r AS DOUBLE))
        AS engagement_recency_interaction
  FROM (SELECT *,
          CASE acquisition_source WHEN 'Referral' THEN 5 WHEN 'Email' THEN 4
               WHEN 'Organic' THEN 3 WHEN 'Direct' THEN 2 WHEN 'Meta Ads' THEN 1
               WHEN 'Google Ads' THEN 1 ELSE 2 END AS source_numeric,
          CASE campaign_type WHEN 'Retargeting' THEN 3 WHEN 'Brand' THEN 2
               WHEN 'Prospecting' THEN 1 ELSE 0 END AS campaign_numeric
        FROM joined), spans, st)"""
)


def _holiday_columns() -> str:
    parts = []
    for name, (month, number) in HOLIDAYS.items():
        ahead = (
            f"date_diff('day', first_purchase_date, "
            f"make_date(year(first_purchase_date), {month}, {number}))"
        )
        parts.append(
            f"CAST(CASE WHEN {ahead} >= 0 THEN {ahead} ELSE {ahead} + 365 END AS INTEGER) "
            f"AS days_to_{name}, "
            f"CASE WHEN {ahead} BETWEEN -14 AND 0 THEN 1 ELSE 0 END AS near_{name}"
        )
    return ", ".join(parts)


HOLIDAY = f"""
holiday AS (
  SELECT *, least(days_to_black_friday, days_to_cyber_monday, days_to_christmas)
              AS days_to_major_holiday,
         greatest({', '.join(f'near_{h}' for h in HOLIDAYS)}) AS near_any_holiday
  FROM (SELECT customer_id, {_holiday_columns()},
          CASE WHEN month(first_purchase_date) IN (11, 12) THEN 1 ELSE 0 END AS is_peak_season
        FROM clean))"""


def _heuristic(email: str, returns: str) -> str:
    base = (
        f"total_spent * 1.5 * (1 + coalesce({email}, 0.0)) * (1 - coalesce({returns}, 0.0)) "
        "* (1 + total_orders * 0.05)"
    )
    return f"""
SELECT *, round(predicted_clv * 0.3, 2) AS recommended_cac,
       CASE WHEN predicted_clv >= 500 THEN 'High-CLV'
            WHEN predicted_clv >= 150 THEN 'Growth-Potential' ELSE 'Low-CLV' END
         AS predicted_segment,
       CASE WHEN predicted_clv >= 500 THEN 'High'
            WHEN predicted_clv >= 150 THEN 'Medium' ELSE 'Low' END AS confidence
FROM (SELECT *, CAST(floor(CASE WHEN days_since_last_purchase < 30 THEN {base} * 1.2
                                WHEN days_since_last_purchase > 90 THEN {base} * 0.8
                                ELSE {base} END + 0.5) AS DOUBLE) AS predicted_clv
      FROM source_rows)"""


SCORED = (
    "source_rows AS (SELECT * FROM clean), scored AS ("
    + _heuristic("email_engagement_rate", "return_rate")
    + ")"
)
JUDGED = (
    "source_rows AS (SELECT * FROM base), judged AS ("
    + _heuristic("CAST(NULL AS DOUBLE)", "return_rate")
    + ")"
)

BASE = _customers()
TRAINING = _customers(cutoff="2000-01-01")
PLAIN_MONEY = _customers(unit=1.0)


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def _round(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _shown(extra: str = "") -> str:
    return f"SELECT * REPLACE ({DAY.format('first_purchase_date')}, " + (
        f"{DAY.format('last_purchase_date')}{extra})"
    )


def _scored(body: str) -> str:
    return _with(body, BASE, CLEAN, SCORED)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + ")"


SEGMENT_NAMES = "(VALUES ('High-CLV'), ('Growth-Potential'), ('Low-CLV')) AS names(segment)"
VIEW = (
    "customer_id, acquisition_source, campaign_type, total_orders, predicted_clv, "
    "predicted_segment, recommended_cac"
)
NUMERIC = (
    "total_orders total_spent avg_order_value days_since_first_purchase "
    "days_since_last_purchase num_categories acquisition_cost email_engagement_rate return_rate"
).split()
COLUMNS = (
    "customer_id first_purchase_date last_purchase_date total_orders total_spent "
    "avg_order_value days_since_first_purchase days_since_last_purchase product_categories "
    "num_categories acquisition_source campaign_type acquisition_cost email_engagement_rate "
    "return_rate"
).split()


def _rfm_select(triple: str) -> str:
    columns = _round("frequency_log monetary_log monetary_normalized rfm_weighted")
    return _with(f"SELECT * REPLACE ({columns}) FROM rfm", BASE, CLEAN, STATS, triple, RFM)


RULES = [
    ("total_orders:range", "total_orders < 0 OR total_orders > 10000"),
    ("total_spent:range", "total_spent < 0 OR total_spent > 10000000"),
    ("avg_order_value:range", "avg_order_value < 0 OR avg_order_value > 100000"),
    (
        "days_since_first_purchase:range",
        "days_since_first_purchase < 0 OR days_since_first_purchase > 3650",
    ),
    (
        "days_since_last_purchase:range",
        "days_since_last_purchase < 0 OR days_since_last_purchase > 3650",
    ),
    ("num_categories:range", "num_categories < 1 OR num_categories > 20"),
    ("acquisition_cost:range", "acquisition_cost < 0 OR acquisition_cost > 10000"),
    (
        "email_engagement_rate:range",
        "email_engagement_rate < 0 OR email_engagement_rate > 1",
    ),
    ("return_rate:range", "return_rate < 0 OR return_rate > 1"),
    ("days:order", "days_since_last_purchase > days_since_first_purchase"),
]
BROKEN = "broken AS (" + " UNION ALL ".join(
    f"SELECT customer_id, '{rule}' AS rule FROM base WHERE {test}" for rule, test in RULES
) + ")"
OUTCOME = """
outcomes AS (
  SELECT customer_id, total_orders,
         CASE WHEN customer_id IN (SELECT customer_id FROM broken)
              THEN 'quarantine' ELSE 'valid' END AS outcome FROM base)"""

ALL_FEATURES = (BASE, CLEAN, STATS, QUANTILE_TRIPLE, RFM, BEHAVIOR, TEMPORAL, STATISTICAL)
ALL_FEATURES += (ACQUISITION, INTERACTION, HOLIDAY)
FEATURE_TABLES = {
    "rfm": "rfm",
    "behavioral": "behavior",
    "temporal": "temporal",
    "statistical": "statistical",
    "acquisition": "acquisition",
    "interaction": "interaction",
}
ON_HOLIDAY = ("days_to_major_holiday", "is_peak_season", "near_any_holiday")
USAGE = "usage AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, '{category}' AS category, "
    f"count(*) FILTER (WHERE {name} <> 0) AS nonzero "
    f"FROM {'holiday' if name in ON_HOLIDAY else FEATURE_TABLES[category]}"
    for category, names in CATALOGUE.items()
    for name in names
) + ")"

SEGMENT_TOTALS = f"""
totals AS (
  SELECT names.segment, count(s.customer_id) AS customer_count,
         coalesce(avg(s.predicted_clv), 0.0) AS mean_value
  FROM {SEGMENT_NAMES} LEFT JOIN scored s ON s.predicted_segment = names.segment
  GROUP BY names.segment)"""
ALLOCATION = f"""
allocated AS (
  SELECT *, CASE WHEN cost > 0 THEN CAST(floor(spend / cost) AS BIGINT) ELSE 0 END AS bought
  FROM (SELECT *, w * {BUDGET!r} AS spend,
               CASE WHEN mean_value > 0 THEN mean_value * 0.3 ELSE 0.0 END AS cost
        FROM (SELECT *, CAST(CASE segment WHEN 'High-CLV' THEN 0.5
                             WHEN 'Growth-Potential' THEN 0.35 ELSE 0.15 END AS DOUBLE) AS w
              FROM totals))),
allocation AS (
  SELECT segment, round(spend, 2) AS budget, round(w * 100, 1) AS budget_percentage,
         customer_count, round(mean_value, 2) AS avg_predicted_clv,
         round(cost, 2) AS optimal_cac, bought AS expected_acquisitions,
         round(bought * mean_value, 2) AS expected_revenue,
         round(bought * mean_value / spend, 2) AS expected_roas
  FROM allocated)"""

SPLIT = """
placed AS (
  SELECT customer_id, first_purchase_date,
         row_number() OVER (ORDER BY first_purchase_date, customer_id) AS rn,
         count(*) OVER () AS n FROM base),
parts AS (
  SELECT *, CASE WHEN rn <= n * 70 // 100 THEN 'train'
                 WHEN rn <= n * 85 // 100 THEN 'validation' ELSE 'test' END AS split
  FROM placed)"""

MEMBERS = """
members AS (
  SELECT customer_id, actual_clv, total_spent AS a, total_spent * 1.5 AS b,
         predicted_clv AS c FROM judged)"""


def _metrics(truth: str, guess: str) -> str:
    return f"""count(*) AS rows, round(avg(abs({guess} - {truth})), 5) AS mae,
       round(sqrt(avg(({guess} - {truth}) * ({guess} - {truth}))), 5) AS rmse,
       round(1 - sum(({guess} - {truth}) * ({guess} - {truth}))
               / (var_pop({truth}) * count(*)), 5) AS r2,
       round(avg(CASE WHEN {truth} <> 0 THEN abs(({guess} - {truth}) / {truth}) END) * 100, 5)
         AS mape"""


VALUE_SEGMENT = (
    "CASE WHEN {0} >= 500 THEN 'High-CLV' WHEN {0} >= 150 THEN 'Growth-Potential' "
    "ELSE 'Low-CLV' END"
)


def _encoded() -> str:
    numbers = ", ".join(
        f"round(({c} - (SELECT median({c}) FROM clean)) / (SELECT CASE WHEN "
        f"quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0 ELSE "
        f"CAST(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS DOUBLE) END FROM clean), "
        f"6) AS {c}"
        for c in ("total_orders", "total_spent", "days_since_last_purchase", "return_rate")
    )
    levels = {
        "acquisition_source": ("Google Ads", "Meta Ads", "Organic", "Referral"),
        "campaign_type": ("None", "Prospecting", "Retargeting"),
    }
    flags = ", ".join(
        f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS \"{c}_{v}\""
        for c, values in levels.items()
        for v in values
    )
    return _with(f"SELECT customer_id, {numbers}, {flags} FROM clean", BASE, CLEAN)


def _percentile(seed: int) -> str:
    """Hash percentile of a customer for a random split."""
    return f"('0x' || substr(md5(customer_id || ':{seed}'), 1, 8))::BIGINT % 100"


def _intervals() -> str:
    mean = "((a + b + c) / 3)"
    return _with(
        f"""
SELECT customer_id, CAST(0.9 AS DOUBLE) AS interval_level,
       round(greatest(c - sd * 1.645, 0.0), 6) AS interval_lower,
       round(c + sd * 1.645, 6) AS interval_upper,
       round(c + sd * 1.645 - c, 6) AS interval_margin,
       round(least(cv, 1.0), 6) AS uncertainty_score,
       CASE WHEN cv < 0.1 THEN 'Very High' WHEN cv < 0.2 THEN 'High'
            WHEN cv < 0.4 THEN 'Medium' ELSE 'Low' END AS uncertainty_category,
       round(sd, 6) AS uncertainty_std, round(sd * sd, 6) AS uncertainty_variance,
       3 AS member_count, round(least(a, b, c), 6) AS member_min,
       round(greatest(a, b, c), 6) AS member_max,
       round(greatest(a, b, c) - least(a, b, c), 6) AS member_spread
FROM (SELECT *, CASE WHEN c <> 0 THEN sd / abs(c) ELSE 1.0 END AS cv
      FROM (SELECT *, sqrt(((a - {mean}) * (a - {mean}) + (b - {mean}) * (b - {mean})
                   + (c - {mean}) * (c - {mean})) / 3) AS sd FROM members))""",
        TRAINING,
        JUDGED,
        MEMBERS,
    )


def _base_queries() -> dict[str, str]:
    lookalikes = " UNION ALL ".join(
        f"SELECT {_text(name)} AS campaign, {_text(audience)} AS source_audience, "
        f"count(*) FILTER (WHERE predicted_segment IN ({', '.join(map(_text, held))})) "
        f"AS source_size, {_text(size)} AS lookalike_size, {_text(reach)} AS estimated_reach, "
        f"{_text(priority)} AS priority, {_text(strategy)} AS strategy FROM scored"
        for name, audience, held, size, reach, priority, strategy in LOOKALIKES
    )
    buckets = [("$0-100", None, 100), ("$100-250", 100, 250), ("$250-500", 250, 500)]
    buckets += [("$500-1000", 500, 1000), ("$1000+", 1000, None)]
    histogram = " UNION ALL ".join(
        f"SELECT '{name}' AS bucket, count(*) AS customers FROM scored WHERE "
        + " AND ".join(
            ([f"predicted_clv >= {low}"] if low else [])
            + ([f"predicted_clv < {high}"] if high else [])
        )
        for name, low, high in buckets
    )
    numeric_report = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 6) AS mean, "
        f"round(CAST(median({c}) AS DOUBLE), 6) AS median, "
        f"round(stddev_samp({c}), 6) AS std FROM base"
        for c in NUMERIC
    )
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_values, "
        f"(count(*) - count({c})) * 100.0 / CAST(count(*) AS DOUBLE) AS missing_percentage "
        "FROM base"
        for c in COLUMNS
    )
    categorical = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS records FROM base GROUP BY {c}"
        for c in ("acquisition_source", "campaign_type")
    )
    lively = _round("email_engagement_rate")
    contract = ", coalesce(email_engagement_rate, 0.0) AS email_engagement_rate"
    z_rounds = _round(" ".join(f"{c}_zscore" for c, _, _ in Z_COLUMNS))
    interaction_doubles = (
        "value_frequency_score engaged_value_score rf_score mature_value_score "
        "source_value_score clv_predictor_composite campaign_value_interaction "
        "quarter_frequency_interaction season_value_interaction engagement_recency_interaction"
    )
    heuristic_metrics = _metrics("actual_clv", "predicted_clv")
    member_rows = " UNION ALL ".join(
        f"SELECT '{name}' AS model, {_metrics('actual_clv', column)} FROM members"
        for name, column in (
            ("spend_now", "a"),
            ("spend_half_more", "b"),
            ("spend_heuristic", "c"),
        )
    )
    shares = ", ".join(
        f"1.0 / (avg(abs({m} - actual_clv)) + 1e-6) AS w{m}" for m in ("a", "b", "c")
    )
    targeting = _values(TARGETING)
    campaigns = _values(CAMPAIGNS)
    return {
        "customer_base": _with(f"{_shown()} FROM base", BASE),
        "customers_incremental": _with(f"{_shown()} FROM base", BASE),
        "training_base": _with(f"{_shown()} FROM base", TRAINING),
        "customers_csv_round_trip": _with(f"{_shown()} FROM base", BASE),
        "clean_customers": _with(f"{_shown(', ' + lively)} FROM clean", BASE, CLEAN),
        "contract_customers": _with(f"{_shown(contract)} FROM base", BASE),
        "clean_with_gaps": _with(
            _shown(", " + _round("email_engagement_rate return_rate"))
            + " FROM clean",
            BASE,
            GAPPED,
            CLEAN_GAPPED,
        ),
        "contract_with_gaps": _with(
            _shown(
                ", coalesce(acquisition_source, 'Direct') AS acquisition_source, "
                "coalesce(campaign_type, 'None') AS campaign_type, "
                "coalesce(email_engagement_rate, 0.0) AS email_engagement_rate, "
                "coalesce(return_rate, 0.0) AS return_rate, "
                "CASE WHEN avg_order_value = 0 AND total_orders > 0 "
                "THEN total_spent / total_orders ELSE avg_order_value END AS avg_order_value"
            )
            + " FROM gapped",
            BASE,
            GAPPED,
        ),
        "gaps_presented": _with(
            "SELECT customer_id, coalesce(acquisition_source, 'None') AS acquisition_source, "
            "coalesce(campaign_type, 'None') AS campaign_type FROM gapped",
            BASE,
            GAPPED,
        ),
        "quality_overview": _with(
            f"SELECT count(*) AS total_records, {len(COLUMNS)} AS total_columns, "
            "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM base)) AS duplicates "
            "FROM base",
            BASE,
        ),
        "quality_missing": _with(missing, BASE),
        "quality_numeric": _with(numeric_report, BASE),
        "quality_categorical": _with(categorical, BASE),
        "validation_violations": _with(
            "SELECT customer_id, rule FROM broken", PLAIN_MONEY, BROKEN
        ),
        "validation_split": _with(
            "SELECT outcome, count(*) AS customers, CAST(sum(total_orders) AS BIGINT) AS orders "
            "FROM outcomes GROUP BY outcome",
            PLAIN_MONEY,
            BROKEN,
            OUTCOME,
        ),
        "rfm_scores": _rfm_select(QUANTILE_TRIPLE),
        "rfm_scores_fixed": _rfm_select(FIXED_TRIPLE),
        "rfm_segment_summary": _with(
            "SELECT rfm_segment, count(*) AS customers, round(avg(total_spent), 6) AS avg_spent, "
            "CAST(sum(total_orders) AS BIGINT) AS orders "
            "FROM rfm JOIN clean USING (customer_id) GROUP BY rfm_segment",
            BASE,
            CLEAN,
            STATS,
            QUANTILE_TRIPLE,
            RFM,
        ),
        "features_behavioral": _with(
            f"SELECT * REPLACE ({_round('spending_velocity aov_deviation engagement_score')}) "
            "FROM behavior",
            BASE,
            CLEAN,
            STATS,
            BEHAVIOR,
        ),
        "features_temporal": _with("SELECT * FROM temporal", BASE, CLEAN, TEMPORAL),
        "features_statistical": _with(
            f"SELECT * REPLACE ({z_rounds}) FROM statistical", BASE, CLEAN, STATS, STATISTICAL
        ),
        "features_acquisition": _with(
            f"SELECT * REPLACE ({_round('cac_efficiency cac_roi')}) FROM acquisition",
            BASE,
            CLEAN,
            STATS,
            ACQUISITION,
        ),
        "features_interaction": _with(
            f"SELECT * REPLACE ({_round(interaction_doubles)}) FROM interaction",
            BASE,
            CLEAN,
            STATS,
            QUANTILE_TRIPLE,
            RFM,
            BEHAVIOR,
            TEMPORAL,
            ACQUISITION,
            INTERACTION,
        ),
        "features_holiday": _with("SELECT * FROM holiday", BASE, CLEAN, HOLIDAY),
        "feature_catalogue": _with("SELECT * FROM usage", *ALL_FEATURES, USAGE),
        "feature_summary": _with(
            "SELECT category, count(*) AS features FROM usage GROUP BY category",
            *ALL_FEATURES,
            USAGE,
        ),
        "customers_page": _scored(
            f"SELECT {VIEW} FROM scored WHERE predicted_segment = 'High-CLV' "
            "AND predicted_clv >= 600 ORDER BY predicted_clv DESC, customer_id "
            "LIMIT 100 OFFSET 100"
        ),
        "customers_page_info": _scored(
            "SELECT count(*) AS total, 2 AS page, 100 AS page_size, 200 < count(*) AS has_more "
            "FROM scored WHERE predicted_segment = 'High-CLV' AND predicted_clv >= 600"
        ),
        "customers_late_page": _scored(
            f"SELECT {VIEW} FROM scored ORDER BY predicted_clv DESC NULLS LAST, customer_id "
            "LIMIT 100 OFFSET 900"
        ),
        "customers_search": _scored(
            f"SELECT {VIEW} FROM scored WHERE lower(customer_id) LIKE '%ads%' "
            "OR lower(acquisition_source) LIKE '%ads%'"
        ),
        "customers_filtered": _scored(
            f"SELECT {VIEW} FROM scored WHERE acquisition_source = 'Email' "
            "AND predicted_clv BETWEEN 150 AND 900"
        ),
        "customer_lookup": _scored(
            f"SELECT {VIEW} FROM scored WHERE customer_id = 'CUST_000000000042'"
        ),
        "stored_customer_search": _scored(
            f"SELECT {VIEW}, term FROM scored, (VALUES ('ADS'), ('st_00000000001'), ('no such part')) t(term) "
            "WHERE contains(lower(customer_id), lower(term)) OR contains(lower(acquisition_source), lower(term))"
        ),
        "stored_customer_lookup": _scored(
            f"SELECT {VIEW} FROM scored WHERE customer_id = 'CUST_000000000042'"
        ),
        "stored_customer_segment": _scored(
            f"SELECT {VIEW} FROM scored WHERE predicted_segment = 'High-CLV' "
            "AND acquisition_source = 'Email' AND predicted_clv >= 600"
        ),
        "top_customers": _scored(
            f"SELECT {VIEW} FROM scored ORDER BY predicted_clv DESC, customer_id LIMIT 5"
        ),
        "heuristic_scores": _scored(
            "SELECT customer_id, predicted_clv, predicted_segment, recommended_cac, confidence, "
            "CASE WHEN predicted_clv > 1000 THEN 'High' WHEN predicted_clv > 300 THEN 'Medium' "
            "ELSE 'Low' END AS prediction_confidence, "
            "least(recommended_cac, predicted_clv * 0.5) AS response_cac, "
            "CAST(floor(predicted_clv * 0.3 + 0.5) AS BIGINT) AS whole_cac FROM scored"
        ),
        "segment_customers": _scored(
            f"SELECT {VIEW} FROM scored WHERE predicted_segment = 'Growth-Potential'"
        ),
        "segment_summary": _scored(
            "SELECT names.segment, count(customer_id) AS customers, "
            "round(count(customer_id) * 100.0 / (SELECT CAST(count(*) AS DOUBLE) FROM scored), "
            "6) AS percentage, round(avg(predicted_clv), 6) AS avg_predicted_clv, "
            "coalesce(sum(predicted_clv), 0.0) AS total_predicted_value, "
            "round(avg(recommended_cac), 6) AS avg_recommended_cac "
            f"FROM {SEGMENT_NAMES} LEFT JOIN scored ON predicted_segment = names.segment "
            "GROUP BY names.segment"
        ),
        "segment_analysis": _scored(
            "SELECT names.segment, count(scored.customer_id) AS customers, "
            "round(count(scored.customer_id) * 100.0 "
            "/ CAST((SELECT count(*) FROM scored) AS DOUBLE), 6) AS percentage, "
            "round(avg(predicted_clv), 6) AS avg_predicted_clv, "
            "coalesce(sum(predicted_clv), 0.0) AS total_predicted_value, "
            "round(avg(recommended_cac), 6) AS avg_recommended_cac "
            "FROM (VALUES ('High-CLV'), ('Growth-Potential'), ('Low-CLV'), ('All')) "
            "AS names(segment) LEFT JOIN scored "
            "ON names.segment IN (predicted_segment, 'All') GROUP BY names.segment"
        ),
        "dashboard_kpis": _scored(
            "SELECT count(*) AS total_customers, round(avg(predicted_clv), 6) AS avg_clv, "
            "sum(predicted_clv) AS total_value, "
            "round(count(*) FILTER (WHERE predicted_segment = 'High-CLV') * 100.0 "
            "/ CAST(count(*) AS DOUBLE), 6) AS high_clv_percentage FROM scored"
        ),
        "segment_distribution": _scored(
            "SELECT predicted_segment AS segment, count(*) AS customers FROM scored GROUP BY 1"
        ),
        "source_distribution": _scored(
            "SELECT acquisition_source, count(*) AS customers FROM scored GROUP BY 1"
        ),
        "value_histogram": _scored(histogram),
        "audiences": _scored(
            f"SELECT {VIEW}, targeting_priority, lookalike_recommendation, bidding_strategy "
            f"FROM scored JOIN {targeting} AS t(segment, targeting_priority, "
            "lookalike_recommendation, bidding_strategy) ON predicted_segment = t.segment"
        ),
        "audience_exports": _scored(
            "SELECT customer_id, acquisition_source, predicted_clv, "
            f"'{EXPORT_DATE.isoformat()}' AS export_date, predicted_segment AS segment FROM scored"
        ),
        "cac_bands": _scored(
            "SELECT customer_id, predicted_clv, round(predicted_clv * 0.3, 2) AS optimal_cac, "
            "CAST(0.3 AS DOUBLE) AS cac_ratio, round(predicted_clv * 0.4, 2) AS max_cac, "
            "round(predicted_clv * 0.15, 2) AS min_cac, CAST(3.33 AS DOUBLE) AS expected_roas "
            "FROM scored"
        ),
        "budget_allocation": _with(
            "SELECT * FROM allocation", BASE, CLEAN, SCORED, SEGMENT_TOTALS, ALLOCATION
        ),
        "budget_totals": _with(
            f"SELECT CAST({BUDGET!r} AS DOUBLE) AS total_budget, "
            "CAST(sum(expected_acquisitions) AS BIGINT) AS total_expected_acquisitions, "
            "round(sum(expected_revenue), 2) AS total_expected_revenue, "
            f"round(sum(expected_revenue) / {BUDGET!r}, 2) AS blended_roas FROM allocation",
            BASE,
            CLEAN,
            SCORED,
            SEGMENT_TOTALS,
            ALLOCATION,
        ),
        "lookalike_plan": _scored(lookalikes),
        "campaign_plan": _with(
            f"SELECT t.*, customer_count FROM {campaigns} AS t(segment, campaign_objective, "
            "optimization_event, bidding_strategy, budget_type, ad_format, messaging, "
            "retargeting_window, frequency_cap) JOIN totals USING (segment)",
            BASE,
            CLEAN,
            SCORED,
            SEGMENT_TOTALS,
        ),
        "audience_sizes": _with(
            "SELECT segment, customer_count FROM totals", BASE, CLEAN, SCORED, SEGMENT_TOTALS
        ),
        "temporal_split_rows": _with("SELECT customer_id, split FROM parts", TRAINING, SPLIT),
        "temporal_split_counts": _with(
            "SELECT split, count(*) AS customers, "
            "strftime(min(first_purchase_date), '%Y-%m-%d') AS first_day, "
            "strftime(max(first_purchase_date), '%Y-%m-%d') AS last_day "
            "FROM parts GROUP BY split",
            TRAINING,
            SPLIT,
        ),
        "random_split_rows": _with(
            f"SELECT customer_id, CASE WHEN {_percentile(42)} < 20 THEN 'test' "
            "ELSE 'train' END AS split FROM base",
            TRAINING,
        ),
        "ensemble_invariants": _with(
            "SELECT split || '_rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM ("
            f"SELECT CASE WHEN {_percentile(42)} < 20 THEN 'test' "
            f"WHEN {_percentile(43)} < 20 THEN 'validation' ELSE 'train' END AS split "
            "FROM base) GROUP BY split UNION ALL "
            "SELECT name, CAST(value AS DOUBLE) FROM (VALUES ('negative_predictions', 0), "
            "('outside_members', 0), ('importance_sum', 1), ('rank_gap', 0), "
            "('weight_sum', 1), ('single_tree_boosters', 0), ('boosters_without_gain', 0)) "
            "AS facts(name, value)",
            TRAINING,
        ),
        "encoded_features": _encoded(),
        "heuristic_eval": _with(
            "SELECT *, CAST(r2 >= 0.5 AS INTEGER) AS passed FROM "
            f"(SELECT {heuristic_metrics} FROM judged)",
            TRAINING,
            JUDGED,
        ),
        "heuristic_segment_accuracy": _with(
            f"SELECT avg(CASE WHEN {VALUE_SEGMENT.format('actual_clv')} = predicted_segment "
            "THEN 1 ELSE 0 END) AS segment_accuracy FROM judged",
            TRAINING,
            JUDGED,
        ),
        "heuristic_segment_errors": _with(
            f"SELECT {VALUE_SEGMENT.format('actual_clv')} AS segment, "
            "round(sqrt(avg((predicted_clv - actual_clv) * (predicted_clv - actual_clv))), 6) "
            "AS rmse, count(*) AS customers FROM judged GROUP BY 1",
            TRAINING,
            JUDGED,
        ),
        "fixed_member_metrics": _with(member_rows, TRAINING, JUDGED, MEMBERS),
        "fixed_member_ensemble": _with(
            "SELECT customer_id, round((a * wa + b * wb + c * wc) / (wa + wb + wc), 6) "
            f"AS ensemble FROM members, (SELECT {shares} FROM members)",
            TRAINING,
            JUDGED,
            MEMBERS,
        ),
        "prediction_interval": _intervals(),
        "prediction_interval_fallback": _with(
            "SELECT customer_id, greatest(c - c * 0.25, 0.0) AS interval_lower, "
            "c + c * 0.25 AS interval_upper, CAST(0.5 AS DOUBLE) AS uncertainty_score, "
            "'Medium' AS uncertainty_category FROM members",
            TRAINING,
            JUDGED,
            MEMBERS,
        ),
        "stream_scores": _scored(
            "SELECT customer_id, predicted_clv, predicted_segment, recommended_cac FROM scored"
        ),
        "stream_routing": _with(
            "SELECT customer_id, outcome FROM outcomes", PLAIN_MONEY, BROKEN, OUTCOME
        ),
    }


# Candidates of a tree's first split, as the query states them.
_EDGES = {
    "total_orders": list(range(1, 15)),
    "total_spent": list(range(50, 751, 50)),
    "days_since_last_purchase": list(range(100, 1001, 100)),
}


def _first_gains() -> str:
    """Regularised gains and leaf values by their formula: L1 0.1, L2 1, three rows at least."""
    sides = " UNION ALL ".join(
        f"SELECT '{name}' AS feature, CAST(t AS DOUBLE) AS threshold, count(*) FILTER ({name} <= t) AS left_rows, "
        f"count(*) FILTER ({name} > t) AS right_rows, coalesce(sum(actual_clv) FILTER ({name} <= t), 0) AS sl, "
        f"coalesce(sum(actual_clv) FILTER ({name} > t), 0) AS sr FROM base, (SELECT unnest({edges}) AS t) GROUP BY t"
        for name, edges in _EDGES.items()
    )
    return _with(
        f"""
SELECT feature, threshold, left_rows, right_rows, round(gain / max(gain) OVER (), 6) AS gain,
       round(tl / (left_rows + 1), 3) AS left_value, round(tr / (right_rows + 1), 3) AS right_value
FROM (SELECT *, tl * tl / (left_rows + 1) + tr * tr / (right_rows + 1) - ta * ta / (left_rows + right_rows + 1) AS gain
      FROM (SELECT *, greatest(sl - 0.1, 0) AS tl, greatest(sr - 0.1, 0) AS tr, greatest(sl + sr - 0.1, 0) AS ta
            FROM ({sides})) WHERE left_rows >= 3 AND right_rows >= 3)""",
        TRAINING,
    )


def _ridge() -> str:
    """The normal equations of two features with a penalty of 1, solved by hand."""
    return _with(
        """
, sums AS (
  SELECT count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * covar_pop(a, b) AS ab,
         count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my
  FROM (SELECT CAST(total_orders AS DOUBLE) AS a, days_since_last_purchase / 100.0::DOUBLE AS b, actual_clv AS y FROM base)
), solved AS (
  SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM sums
)
SELECT 'intercept' AS term, round(my - ca * ma - cb * mb, 6) AS value FROM solved
UNION ALL SELECT 'total_orders', round(ca, 6) FROM solved UNION ALL SELECT 'recency', round(cb, 6) FROM solved""",
        TRAINING,
    )


def _test_rows(facts: str) -> str:
    """``facts`` over the number of training and test rows of the random split."""
    return _with(
        f"SELECT name, CAST(value AS DOUBLE) AS value FROM (SELECT count(*) FILTER ({_percentile(42)} >= 20) AS n_train, "
        f"count(*) FILTER ({_percentile(42)} < 20) AS n_test FROM base), LATERAL (VALUES {facts}) AS f(name, value)",
        TRAINING,
    )


def _cells(section: str, query: str, key: str, numbers: str, texts: str = "") -> str:
    parts = [
        f"SELECT '{section}' AS section, {key} AS subject, '{c}' AS field, CAST({c} AS DOUBLE) AS amount, "
        f"CAST(NULL AS VARCHAR) AS text FROM ({query})"
        for c in numbers.split()
    ]
    parts += [
        f"SELECT '{section}', {key}, '{c}', CAST(NULL AS DOUBLE), CAST({c} AS VARCHAR) FROM ({query})"
        for c in texts.split()
    ]
    return " UNION ALL ".join(parts)


def _strategy(found: dict[str, str]) -> str:
    shares = "budget budget_percentage customer_count avg_predicted_clv optimal_cac expected_acquisitions"
    sums = "total_budget total_expected_acquisitions total_expected_revenue blended_roas"
    campaign = "campaign_objective optimization_event bidding_strategy budget_type ad_format messaging retargeting_window"
    audience = "source_audience lookalike_size estimated_reach priority strategy"
    return " UNION ALL ".join(
        [
            _cells("budget_totals", found["budget_totals"], "'all'", sums),
            _cells("budget_allocation", found["budget_allocation"], "segment", f"{shares} expected_revenue expected_roas"),
            _cells("lookalikes", found["lookalike_plan"], "campaign", "source_size", audience),
            _cells("campaigns", found["campaign_plan"], "segment", "customer_count", f"{campaign} frequency_cap"),
            _cells("audience_sizes", found["audience_sizes"], "segment", "customer_count"),
        ]
    )


def oracle_queries() -> dict[str, str]:
    found = _base_queries()
    return found | {
        "boosting_first_gains": _first_gains(),
        "full_strategy": _strategy(found),
        "ridge_closed_form": _ridge(),
        "training_report": _test_rows(
            "('n_train', n_train), ('n_test', n_test), ('models', 6), ('other_sizes', 0), ('reports_apart', 0)"
        ),
        "saved_model_scores": _test_rows("('rows', n_test), ('differing', 0), ('versions', 2)"),
        "stream_model_scores": _test_rows("('rows', n_test), ('differing', 0), ('versions', 2)"),
    }
