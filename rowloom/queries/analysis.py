"""Aggregates, roll-ups and the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import aggregate, profile
from rowloom.queries.book import query, r6


@query(
    "i1_group_aggregate",
    """SELECT o_orderpriority, k, count(o_totalprice) AS n, count(DISTINCT o_custkey) AS customers,
              round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS average,
              round(quantile_cont(o_totalprice, 0.5), 4) AS mid, min(o_totalprice) AS low, max(o_totalprice) AS high,
              round(stddev_samp(o_totalprice), 4) AS o_totalprice_std
       FROM (SELECT *, nullif(o_orderstatus, 'P') AS k FROM orders) GROUP BY ALL""",
)
def i1(t):
    o = t("orders").withColumn("k", F.nullif("o_orderstatus", F.lit("P")))
    specs = [
        {"column": "o_totalprice", "func": "count", "alias": "n"},
        {"column": "o_custkey", "func": "nunique", "alias": "customers"},
        {"column": "o_totalprice", "func": "sum", "alias": "total"},
        {"column": "o_totalprice", "func": "mean", "alias": "average"},
        {"column": "o_totalprice", "func": "median", "alias": "mid"},
        {"column": "o_totalprice", "func": "min", "alias": "low"},
        {"column": "o_totalprice", "func": "max", "alias": "high"},
        {"column": "o_totalprice", "func": "std"},
        {"column": "nothing", "func": "sum"},
        {"column": "o_totalprice", "func": "first"},
    ]
    out = aggregate.group_aggregate(o, ["o_orderpriority", "k"], specs)
    rounded = ("total", "average", "mid", "o_totalprice_std")
    return out.select(*[F.round(c, 4).alias(c) if c in rounded else F.col(c) for c in out.columns])


@query(
    "i1_group_median_spread",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS mid, count(*) AS n FROM lineitem GROUP BY 1""",
)
def i1_median(t):
    """The way taken when a group may be too big for one task."""
    specs = [{"column": "l_extendedprice", "func": "median", "alias": "mid"}, {"column": "l_quantity", "func": "count", "alias": "n"}]
    out = aggregate.group_aggregate(t("lineitem"), ["l_returnflag"], specs, direct_rows=0)
    return out.select("l_returnflag", r6("mid").alias("mid"), "n")


_FUNCS = {
    "count": "CAST(count(*) AS DOUBLE)",
    "distinct_count": "CAST(count(DISTINCT CAST(o_custkey AS VARCHAR)) AS DOUBLE)",
    "sum": "round(sum(o_totalprice), 4)",
    "mean": "round(avg(o_totalprice), 4)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
    "median": "round(quantile_cont(o_totalprice, 0.5), 4)",
    "variance": "round(var_pop(o_totalprice) / 1000000, 4)",
    "stddev": "round(stddev_pop(o_totalprice), 4)",
}


def _i3(func, sql):
    @query(
        f"i3_metric_{func}",
        f"SELECT concat_ws(' | ', coalesce(nullif(o_orderstatus, 'P'), 'Unknown'), o_orderpriority) AS label, {sql} AS value FROM orders GROUP BY 1",
    )
    def f(t):
        o = t("orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")))
        column = "o_custkey" if func == "distinct_count" else "o_totalprice"
        out = aggregate.rollup_by_dimensions(o, ["status", "o_orderpriority"], column, func)
        value = F.col("value") / 1000000 if func == "variance" else F.col("value")
        return out.select("label", F.round(value, 4).alias("value"))


for _f, _s in _FUNCS.items():
    _i3(_f, _s)


@query(
    "i2_rollup_by_dimensions",
    """SELECT strftime(o_orderdate, '%Y-%m') || ' | ' || o_orderstatus AS label, round(sum(o_totalprice), 4) AS value
       FROM orders GROUP BY 1""",
)
def i2(t):
    out = aggregate.rollup_by_dimensions(t("orders"), ["o_orderdate", "o_orderstatus"], "o_totalprice", "sum", "month")
    return out.select("label", F.round("value", 4).alias("value"))


@query("i4_kpi", "SELECT round(avg(o_totalprice), 4) AS value FROM orders")
def i4(t):
    total, _ = aggregate.kpi(t("orders"), "o_totalprice", "mean")
    return total.select(F.round("value", 4).alias("value"))


@query(
    "i4_kpi_trend",
    """SELECT CAST(o_orderdate AS DATE)::VARCHAR AS label, round(sum(o_totalprice), 4) AS value
       FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24""",
)
def i4_trend(t):
    o = t("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    _, trend = aggregate.kpi(o, "o_totalprice", "sum", "day")
    return trend.select("label", F.round("value", 4).alias("value"))


@query(
    "i5_timeline",
    """SELECT strftime(o_orderdate, '%Y-%m') AS label, CAST(count(*) AS DOUBLE) AS value
       FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24""",
)
def i5(t):
    return aggregate.timeline(t("orders"), ["o_orderdate"], None, "count", "month")


@query(
    "i5b_chart",
    """SELECT p_brand AS label, round(sum(l_extendedprice), 3) AS value FROM lineitem JOIN part ON p_partkey = l_partkey
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
)
def i5b(t):
    sold = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    out = aggregate.chart(sold, ["p_brand"], "l_extendedprice", "sum")
    return out.select("label", F.round("value", 3).alias("value"))


@query(
    "i6_hierarchical_rollup",
    """WITH leaf AS (SELECT r_name AS a, n_name AS b, c_mktsegment AS c, avg(c_acctbal) AS s
                     FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL),
            mid AS (SELECT a, b, sum(s) AS s FROM leaf GROUP BY ALL), top AS (SELECT a, sum(s) AS s FROM mid GROUP BY a),
            roots AS (SELECT a FROM top ORDER BY s DESC, a LIMIT 3)
       SELECT CAST(3 AS INT) AS level, concat_ws(' | ', a, b, c) AS path, c AS name, round(s, 4) AS size FROM leaf WHERE a IN (FROM roots)
       UNION ALL SELECT 2, concat_ws(' | ', a, b), b, round(s, 4) FROM mid WHERE a IN (FROM roots)
       UNION ALL SELECT 1, a, a, round(s, 4) FROM top WHERE a IN (FROM roots)""",
)
def i6(t):
    c = t("customer").join(F.broadcast(t("nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    c = c.join(F.broadcast(t("region")), F.col("r_regionkey") == F.col("n_regionkey"))
    out = aggregate.hierarchical_rollup(c, ["r_name", "n_name", "c_mktsegment"], "c_acctbal", "mean", 3)
    return out.select("level", "path", "name", F.round("size", 4).alias("size"))


@query(
    "i7_map_points",
    """SELECT c_custkey, c_acctbal / 100 AS lat, (c_custkey % 400 - 200)::DOUBLE AS lng,
              CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'defunct' ELSE lower(c_mktsegment) END AS status
       FROM customer WHERE c_acctbal / 100 BETWEEN -90 AND 90 AND c_custkey % 400 - 200 BETWEEN -180 AND 180
       ORDER BY c_custkey LIMIT 1200""",
)
def i7(t):
    c = t("customer").select(
        "c_custkey",
        (F.col("c_acctbal") / 100).alias("Latitude"),
        (F.col("c_custkey") % 400 - 200).cast("string").alias("geo_lon"),
        F.when(F.col("c_mktsegment") == "BUILDING", " Online")
        .when(F.col("c_mktsegment") == "MACHINERY", "0")
        .otherwise(F.col("c_mktsegment"))
        .alias("Gauge Status"),
    )
    return aggregate.map_points(c, order_by=["c_custkey"]).select("c_custkey", "lat", "lng", "status")


@query(
    "i8_column_statistics",
    """SELECT c_custkey, round(var_samp(c_acctbal) OVER () / 1000, 4) AS variance, round(stddev_samp(c_acctbal) OVER (), 4) AS std,
              round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) + 0 AS z FROM customer""",
)
def i8(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    c = aggregate.stats_variance(c, "c_acctbal", "variance")
    c = aggregate.stats_std(c, "c_acctbal", "std")
    c = aggregate.stats_zscore(c, "c_acctbal", "z")
    return c.select("c_custkey", F.round(F.col("variance") / 1000, 4).alias("variance"), F.round("std", 4).alias("std"), r6("z").alias("z"))


# ---- profile -----------------------------------------------------------------

REPEATED = "(SELECT event_type, user_id, CASE WHEN event_id % 4 <> 0 THEN round(value) END AS v FROM events)"


def _repeated(t):
    return t("events").select("event_type", "user_id", F.when(F.col("event_id") % 4 != 0, F.round("value")).alias("v"))


@query(
    "k1_k2_overview",
    f"""SELECT count(*) AS rows, CAST(3 AS BIGINT) AS columns, count(*) - count(v) AS total_missing,
               round((count(*) - count(v)) * 100.0 / (count(*) * 3), 2) AS missing_pct,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED})) AS duplicate_rows,
               round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {REPEATED}))) * 100.0 / count(*), 2) AS duplicate_pct
        FROM {REPEATED}""",
)
def k1(t):
    return profile.overview(_repeated(t))


@query(
    "k3_column_table",
    f"""WITH e AS {REPEATED}, c AS (
          SELECT 'event_type' AS "column", 'string' AS dtype, count(*) AS n, count(event_type) AS held, count(DISTINCT event_type) AS u, FALSE AS num FROM e
          UNION ALL SELECT 'user_id', 'bigint', count(*), count(user_id), count(DISTINCT user_id), TRUE FROM e
          UNION ALL SELECT 'v', 'double', count(*), count(v), count(DISTINCT v), TRUE FROM e)
        SELECT "column", dtype, n - held AS missing, round((n - held) * 100.0 / n, 2) AS missing_pct, u AS "unique",
               round(u * 100.0 / n, 2) AS unique_ratio_pct, u <= 1 AS is_constant, (n - held) * 100.0 / n >= 30 AS high_missing,
               NOT num AND u * 100.0 / n > 60 AS high_cardinality FROM c""",
)
def k3(t):
    return profile.column_table(_repeated(t))


def _k4_sql():
    rows = []
    for c in ("l_quantity", "l_extendedprice", "l_discount"):
        v = f"nullif({c}, 0.0)"
        rows.append(
            f"""SELECT '{c}' AS "column", count({v}) AS non_null, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std,
                 min({v}) AS min, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50,
                 round(quantile_cont({v}, 0.75), 4) AS p75, max({v}) AS max, round(skewness({v}), 4) + 0 AS skewness,
                 round(kurtosis({v}), 4) + 0 AS kurtosis,
                 (SELECT count(*) FROM lineitem, (SELECT quantile_cont({v}, 0.25) AS a, quantile_cont({v}, 0.75) AS b FROM lineitem)
                  WHERE {v} < a - 1.5 * (b - a) OR {v} > b + 1.5 * (b - a)) AS outliers_iqr FROM lineitem"""
        )
    return " UNION ALL ".join(rows)


@query("k4_numeric_summary", _k4_sql())
def k4(t):
    li = t("lineitem").select(*[F.nullif(c, F.lit(0.0)).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    out = profile.numeric_summary(li)
    keep = ("mean", "std", "p25", "p50", "p75", "skewness", "kurtosis")
    return out.select(
        *[(F.round(c, 4) + F.lit(0.0)).alias(c) if c in keep else F.col(f"`{c}`") for c in out.columns if c != "outlier_pct"]
    )


def _k5_sql():
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"]
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0 AS correlation, round(abs(corr({a}, {b})), 6) AS abs_correlation FROM x"
            )
    return f"WITH x AS (SELECT l_orderkey, l_quantity, l_extendedprice, nullif(l_tax, 0.0) AS l_tax FROM lineitem) {' UNION ALL '.join(parts)}"


@query("k5_correlations", _k5_sql())
def k5(t):
    li = t("lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    out = profile.correlations(li)
    return out.select("feature_a", "feature_b", r6("correlation").alias("correlation"), r6("abs_correlation").alias("abs_correlation"))


@query(
    "k6_quality_score",
    f"""WITH e AS {REPEATED}, m AS (
          SELECT round((count(*) - count(v)) * 100.0 / (count(*) * 3), 2) AS miss,
                 round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e))) * 100.0 / count(*), 2) AS dup,
                 CASE WHEN abs(skewness(v)) >= 1 THEN 1 ELSE 0 END + CASE WHEN abs(skewness(user_id)) >= 1 THEN 1 ELSE 0 END AS skewed,
                 CASE WHEN abs(corr(user_id, v)) >= 0.85 THEN 1 ELSE 0 END AS tight FROM e)
        SELECT round(100 - least(35, miss * 1.8) - least(20, dup * 2) - least(10, tight) - least(8, skewed * 0.8), 2) AS quality_score FROM m""",
)
def k6(t):
    df = _repeated(t)
    found = profile.profile(df)
    return df.limit(1).select(F.lit(found["quality_score"]).alias("quality_score"))


@query(
    "k7_k8_k11_k12_profile_rules",
    """WITH x AS (SELECT c_nationkey AS n_nationkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal,
                      c_acctbal * c_acctbal + c_nationkey AS c_double, c_mktsegment, 7 AS fixed, c_name FROM customer),
            m AS (SELECT count(*)::double AS n, corr(n_nationkey, c_acctbal) AS a, corr(n_nationkey, c_double) AS b, corr(c_acctbal, c_double) AS c,
                         count(c_acctbal) / count(*) AS held, count(DISTINCT c_mktsegment) AS classes FROM x),
            s AS (SELECT skewness(n_nationkey) AS k, skewness(c_acctbal) AS a, skewness(c_double) AS d FROM x),
            t AS (SELECT unnest(['n_nationkey', 'c_acctbal', 'c_double']) AS col, unnest([greatest(abs(a), abs(b)), greatest(abs(a), abs(c)) * held, greatest(abs(b), abs(c))]) AS v FROM m)
       SELECT 'target' AS kind, max_by(col, v) AS fact FROM t
       UNION ALL SELECT 'validation', 'random, ' || greatest(2, least(10, floor(n / 50)))::int || ' folds' FROM m
       UNION ALL SELECT 'step', 'delete_columns fixed constant'
       UNION ALL SELECT 'step', 'delete_columns c_name key'
       UNION ALL SELECT 'step', 'fill_missing c_acctbal median' FROM m WHERE held < 1
       UNION ALL SELECT 'step', 'encode_categorical c_mktsegment ' || CASE WHEN classes <= 30 THEN 'one_hot' ELSE 'label' END FROM m
       UNION ALL SELECT 'step', 'scale_numeric n_nationkey ' || CASE WHEN abs(k) >= 1 THEN 'log' ELSE 'z_score' END FROM s
       UNION ALL SELECT 'step', 'scale_numeric c_acctbal ' || CASE WHEN abs(a) >= 1 THEN 'log' ELSE 'z_score' END FROM s
       UNION ALL SELECT 'step', 'scale_numeric c_double ' || CASE WHEN abs(d) >= 1 THEN 'log' ELSE 'z_score' END FROM s""",
)
def k7(t):
    bal = F.col("c_acctbal")
    df = t("customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.when(bal >= 0, bal).alias("c_acctbal"), (bal * bal + F.col("c_nationkey")).alias("c_double"), "c_mktsegment",
        F.lit(7).alias("fixed"), "c_name",
    )
    found = profile.profile(df)
    facts = [("target", found["target_profile"]["suggested_target"])]
    facts += [("validation", f"{found['validation']['method']}, {found['validation']['folds']} folds")]
    facts += [("step", f"{s['op']} {s['column']} {s['how']}") for s in found["suggested_steps"]]
    return df.sparkSession.createDataFrame(facts, "kind string, fact string")


@query(
    "k9_target_signal",
    """WITH x AS (SELECT * FROM lineitem), s AS (
         SELECT 'l_quantity' AS feature, corr(l_quantity, l_extendedprice) AS r FROM x UNION ALL
         SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM x UNION ALL
         SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM x)
       SELECT feature, round(r, 6) + 0 AS correlation, round(abs(r), 6) AS abs_correlation, abs(r) >= 0.98 AS leakage FROM s""",
)
def k9(t):
    out = profile.target_signal(t("lineitem"), "l_extendedprice", ["l_quantity", "l_tax", "l_discount"])
    return out.select("feature", r6("correlation").alias("correlation"), r6("abs_correlation").alias("abs_correlation"), "leakage")


@query(
    "k10_dominant_class",
    """SELECT round(max(n) * 100.0 / sum(n), 2) AS dominant_class_pct FROM (
         SELECT count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY event_type)""",
)
def k10(t):
    return profile.dominant_class(t("events").select(F.nullif("event_type", F.lit("error")).alias("k")), "k")


@query(
    "k13_histogram",
    """WITH m AS (SELECT min(value) AS a, max(value) AS b FROM events),
            c AS (SELECT least(11, floor((value - a) / (b - a) * 12)) AS bin, count(*) AS n FROM events, m GROUP BY 1)
       SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT max(n) FROM c), 6) AS height
       FROM range(0, 12) r(i) LEFT JOIN c ON c.bin = i""",
)
def k13(t):
    return profile.histogram(t("events"), "value").select("bin", "n", r6("height").alias("height"))


@query(
    "k13_top_values",
    """SELECT substr(text, 1, 32) AS label, count(*) AS n,
              round(count(*) * 100.0 / (SELECT count(*) FROM conversations WHERE text <> ''), 6) AS pct
       FROM conversations WHERE text <> '' GROUP BY text ORDER BY n DESC, label, sha256(text) LIMIT 3""",
)
def k13_top(t):
    return profile.top_values(t("conversations"), "text").select("label", "n", r6("pct").alias("pct"))
