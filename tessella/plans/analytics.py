"""Ratio estimates, time series and decomposition over order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import ratio, series
from tessella.session import table

KEYS = ["segment", "status", "priority"]
START, END = 1996, 2000


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as weighted, scored rows: the order is the cluster, the ship date the period."""
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("year"),
        F.date_format("l_shipdate", "yyyy-MM-01").alias("month"),
        F.col("l_orderkey").alias("cluster"),
        (F.col("l_quantity") / 50).alias("weight"),
        (F.col("l_discount") * 5).alias("positive"),
        (F.col("l_tax") * 5).alias("negative"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END").alias("label"),
        F.col("l_returnflag").alias("segment"),
        F.col("l_linestatus").alias("status"),
    )


_BASE = """base AS (
    SELECT CAST(year(l_shipdate) AS BIGINT) AS year, strftime(l_shipdate, '%Y-%m-01') AS month, l_orderkey AS cluster, l_quantity / 50 AS weight,
        l_discount * 5 AS positive, l_tax * 5 AS negative, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 ELSE 0 END AS label,
        l_returnflag AS segment, l_linestatus AS status
    FROM lineitem)"""


def _ratio_sql(groups: str, rows: str = "base", before: str = _BASE) -> str:
    return f"""
    WITH {before},
    per AS (
        SELECT {groups}, cluster, sum(weight * (positive - negative)) AS n, sum(weight) AS d, sum(weight * positive) AS p, sum(weight * negative) AS m, count(*) AS r
        FROM {rows} GROUP BY ALL),
    moments AS (
        SELECT {groups}, count(*) AS clusters, CAST(sum(r) AS BIGINT) AS records, sum(n) AS sn, sum(d) AS sd, sum(p) AS sp, sum(m) AS sm,
            sum(n * n) AS nn, sum(n * d) AS nd, sum(d * d) AS dd
        FROM per GROUP BY ALL)
    SELECT {groups}, clusters, records, round(sd, 6) AS total_weight, round(sn / nullif(sd, 0), 6) AS score,
        round(sp / nullif(sd, 0), 6) AS positive_share, round(sm / nullif(sd, 0), 6) AS negative_share,
        round(sqrt(greatest(0, (clusters / nullif(clusters - 1, 0)) * (nn - 2 * (sn / nullif(sd, 0)) * nd + (sn / nullif(sd, 0)) * (sn / nullif(sd, 0)) * dd)
            / nullif(sd * sd, 0))), 6) AS standard_error
    FROM moments"""


def d1_ratio_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.ratio_estimate(shipments(spark, sf_dir), ["year"])


def d1_ratio_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.ratio_estimate(shipments(spark, sf_dir), ["month"])


def d1_ratio_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.ratio_estimate(shipments(spark, sf_dir), ["year", "segment", "status"])


def d2_hard_ratio_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio.hard_ratio(shipments(spark, sf_dir), ["year"], "status = 'F' AND weight >= 0.2")


def b9_unpivot_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets per line, unpivoted in one scan and estimated by target and year."""
    line = table(spark, sf_dir, "lineitem")
    share = lambda c, k: (F.col(c) * k)
    wide = line.select(
        F.year("l_shipdate").cast("long").alias("year"),
        F.col("l_orderkey").alias("cluster"),
        (F.col("l_quantity") / 50).alias("relevance"),
        share("l_discount", 10).alias("price_presence"),
        share("l_tax", 5).alias("price_positive"),
        share("l_discount", 2).alias("price_negative"),
        share("l_tax", 10).alias("duty_presence"),
        share("l_discount", 5).alias("duty_positive"),
        share("l_tax", 3).alias("duty_negative"),
    )
    rows = ratio.unpivot_targets(wide, ["year", "cluster"], ["price", "duty"], "relevance", ["presence", "positive", "negative"])
    return ratio.ratio_estimate(rows, ["target", "year"])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year cells by flag, status and order priority: summed weight and weighted mean score."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.year("l_shipdate").cast("long").alias("year"),
        F.col("l_returnflag").alias("segment"),
        F.col("l_linestatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        (F.col("l_quantity") / 50).alias("weight"),
        ((F.col("l_discount") - F.col("l_tax")) * 5).alias("score"),
    )
    return series.weighted_groups(rows, ["year", *KEYS])


_CELLS = """cells AS (
    SELECT CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag AS segment, l_linestatus AS status, o_orderpriority AS priority, sum(l_quantity / 50) AS weight,
        sum(l_quantity / 50 * ((l_discount - l_tax) * 5)) / sum(l_quantity / 50) AS score
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
_PARTS = f"""{_CELLS},
    a AS (SELECT segment, status, priority, weight / sum(weight) OVER () AS start_share, score AS start_score FROM cells WHERE year = {START}),
    b AS (SELECT segment, status, priority, weight / sum(weight) OVER () AS end_share, score AS end_score FROM cells WHERE year = {END}),
    parts AS (
        SELECT *, 0.5 * (start_share + end_share) * (end_score - start_score) AS within, 0.5 * (start_score + end_score) * (end_share - start_share) AS composition
        FROM a JOIN b USING (segment, status, priority))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def d15_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.standardise(cells(spark, sf_dir), "year", KEYS))


def d15_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.decomposition(series.contributions(cells(spark, sf_dir), "year", KEYS, START, END)))


def d15_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.contributions(cells(spark, sf_dir), "year", KEYS, START, END))


def d16_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = series.contributions(cells(spark, sf_dir), "year", KEYS, START, END)
    return _rounded(series.contribution_rollup(parts, "priority")).orderBy(F.abs("total").desc(), "priority")


def d14_equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.equal_weight_mean(cells(spark, sf_dir), ["year"]))


def d14_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(series.weighted_groups(cells(spark, sf_dir), ["year", "priority"]))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("month"), F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("value")
    )


_MONTHLY = """monthly AS (
    SELECT strftime(o_orderdate, '%Y-%m-01') AS month, o_orderpriority AS priority, count(*) AS orders, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"""


def d17_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.linear_trend(monthly(spark, sf_dir), "month", "orders", ["priority"])
    return _rounded(out)


def e6_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.trailing_mean(monthly(spark, sf_dir), "month", "orders", 3, ["priority"])
    return _rounded(out.select("month", "priority", "trailing"))


def e7_volume_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.index_to_first(monthly(spark, sf_dir), "month", "orders", ["priority"])
    return _rounded(out.select("month", "priority", "orders", "index"))


def e7_rate_per_100k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events per 100,000 events by day."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    counts = table(spark, sf_dir, "events").groupBy(day).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return _rounded(counts.withColumn("per_100k", F.col("errors") * 100000.0 / F.col("events")))


def e9_endpoint_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.endpoint_change(monthly(spark, sf_dir), "priority", "month", "orders")
    return out.orderBy(F.col("change").desc(), "priority")


QUERIES = {
    f.__name__: f
    for f in (
        d1_ratio_by_year, d1_ratio_by_month, d1_ratio_by_segment, d2_hard_ratio_by_year, b9_unpivot_ratio, d14_equal_weight, d14_pooled,
        d15_standardised, d15_decomposition, d15_contributions, d16_contributions, d17_trend, e6_trailing_mean, e7_volume_index, e7_rate_per_100k, e9_endpoint_change,
    )
}

SQL = {
    "d1_ratio_by_year": _ratio_sql("year"),
    "d1_ratio_by_month": _ratio_sql("month"),
    "d1_ratio_by_segment": _ratio_sql("year, segment, status"),
    "d2_hard_ratio_by_year": _ratio_sql(
        "year",
        "hard",
        _BASE
        + """, hard AS (
        SELECT year, cluster, 1.0::DOUBLE AS weight, CAST(label > 0 AS DOUBLE) AS positive, CAST(label < 0 AS DOUBLE) AS negative
        FROM base WHERE status = 'F' AND weight >= 0.2)""",
    ),
    "b9_unpivot_ratio": _ratio_sql(
        "target, year",
        "long",
        """long AS (
        SELECT 'price' AS target, CAST(year(l_shipdate) AS BIGINT) AS year, l_orderkey AS cluster, l_quantity / 50 * (l_discount * 10) AS weight,
            l_tax * 5 AS positive, l_discount * 2 AS negative FROM lineitem
        UNION ALL
        SELECT 'duty', CAST(year(l_shipdate) AS BIGINT), l_orderkey, l_quantity / 50 * (l_tax * 10), l_discount * 5, l_tax * 3 FROM lineitem)""",
    ),
    "d14_equal_weight": f"WITH {_CELLS} SELECT year, round(avg(score), 6) AS score, count(*) AS cells FROM cells GROUP BY year",
    "d14_pooled": f"""WITH {_CELLS} SELECT year, priority, round(sum(weight), 6) AS weight, round(sum(weight * score) / sum(weight), 6) AS score
        FROM cells GROUP BY year, priority""",
    "d15_standardised": f"""WITH {_CELLS},
        pooled AS (
            SELECT segment, status, priority, sum(weight) / (SELECT sum(weight) FROM cells) AS share, sum(weight * score) / sum(weight) AS mean FROM cells GROUP BY ALL)
        SELECT year, round(sum(weight * score) / sum(weight), 6) AS observed, round(sum(share * score) / sum(share), 6) AS fixed_composition,
            round(sum(weight * mean) / sum(weight), 6) AS composition_only, count(*) AS cells
        FROM cells JOIN pooled USING (segment, status, priority) GROUP BY year""",
    "d15_decomposition": f"""WITH {_PARTS},
        sums AS (SELECT sum(within + composition) AS change, sum(within) AS within, sum(composition) AS composition, count(*) AS shared_cells FROM parts)
        SELECT round(change, 6) AS change, round(within, 6) AS within, round(composition, 6) AS composition, shared_cells,
            round(within / nullif(change, 0), 6) AS within_share, round(composition / nullif(change, 0), 6) AS composition_share FROM sums""",
    "d15_contributions": f"""WITH {_PARTS}
        SELECT segment, status, priority, round(start_share, 6) AS start_share, round(start_score, 6) AS start_score, round(end_share, 6) AS end_share,
            round(end_score, 6) AS end_score, round(within, 6) AS within, round(composition, 6) AS composition, round(within + composition, 6) AS total FROM parts""",
    "d16_contributions": f"""WITH {_PARTS}
        SELECT priority, round(sum(within), 6) AS within, round(sum(composition), 6) AS composition, round(sum(within + composition), 6) AS total
        FROM parts GROUP BY priority""",
    "d17_trend": f"""WITH {_MONTHLY},
        numbered AS (SELECT priority, CAST(row_number() OVER (PARTITION BY priority ORDER BY month) - 1 AS DOUBLE) AS x, CAST(orders AS DOUBLE) AS y FROM monthly)
        SELECT priority, count(*) AS points, round(regr_slope(y, x), 6) AS slope_per_month, round(regr_slope(y, x) * 12, 6) AS slope_per_year,
            round(CASE WHEN var_pop(y) = 0 THEN 0 ELSE regr_r2(y, x) END, 6) AS r_squared FROM numbered GROUP BY priority""",
    "e6_trailing_mean": f"""WITH {_MONTHLY}
        SELECT month, priority, round(avg(orders) OVER (PARTITION BY priority ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS trailing FROM monthly""",
    "e7_volume_index": f"""WITH {_MONTHLY}
        SELECT month, priority, orders, round(orders * 100.0::DOUBLE / first_value(orders) OVER (PARTITION BY priority ORDER BY month), 6) AS "index" FROM monthly""",
    "e7_rate_per_100k": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors,
            round(count(*) FILTER (WHERE event_type = 'error') * 100000.0::DOUBLE / count(*), 6) AS per_100k FROM events GROUP BY 1""",
    "e9_endpoint_change": f"""WITH {_MONTHLY}
        SELECT priority, arg_min(orders, month) AS first, arg_max(orders, month) AS last, arg_max(orders, month) - arg_min(orders, month) AS change
        FROM monthly GROUP BY priority""",
}
