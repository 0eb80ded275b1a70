"""Row operators, ordered operators, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import joins, ordered, rows
from rowloom.operators.columns import fill_missing
from rowloom.operators.ordering import reindex, with_row_index
from rowloom.queries.book import LINEITEM_KEY, query, r6

CANON = r"""
  CASE WHEN lower(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))
       IN ('', 'null', 'none', 'na', 'n/a', 'nan') THEN NULL
       ELSE lower(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) END
"""


@query(
    "c1_drop_duplicates",
    f"""SELECT doc_id, lang, n_chars FROM (
          SELECT *, row_number() OVER (PARTITION BY {CANON.format(c='text')} ORDER BY doc_id) AS k FROM documents)
        WHERE k = 1""",
)
def c1(t):
    out = rows.drop_duplicates(t("documents"), ["text"], "first", order_by=["doc_id"])
    return out.select("doc_id", "lang", "n_chars")


@query(
    "c1_drop_duplicates_last",
    """SELECT max(event_id) AS event_id, upper(event_type) AS kind, user_id FROM events GROUP BY 2, 3""",
)
def c1_last(t):
    padded = t("events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
        .otherwise(F.col("event_type"))
        .alias("kind"),
        "user_id",
    )
    out = rows.drop_duplicates(padded, ["kind", "user_id"], "last", order_by=["event_id"])
    return out.select("event_id", F.upper(F.trim("kind")).alias("kind"), "user_id")


@query(
    "c1_drop_duplicates_none",
    """SELECT event_id, value FROM events QUALIFY count(*) OVER (PARTITION BY event_type, value) = 1""",
)
def c1_none(t):
    out = rows.drop_duplicates(t("events"), ["event_type", "value"], "none", order_by=["event_id"])
    return out.select("event_id", "value")


@query(
    "c2_sort_rows",
    """SELECT row_number() OVER (ORDER BY nullif(l_discount, 0.0) DESC NULLS LAST, l_orderkey, l_linenumber,
              l_partkey, l_suppkey, l_shipdate) - 1 AS _row_index, l_orderkey, l_linenumber, l_partkey,
              nullif(l_discount, 0.0) AS l_discount FROM lineitem""",
)
def c2(t):
    li = t("lineitem").select(*LINEITEM_KEY, F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    out = rows.sort_rows(with_row_index(li, LINEITEM_KEY), "l_discount", ascending=False)
    return out.select("_row_index", "l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query(
    "c3_drop_missing_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem
       WHERE l_discount <> 0 AND l_tax <> 0""",
)
def c3(t):
    li = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
    )
    return rows.drop_missing_rows(li, ["l_discount", "l_tax"], "any")


@query(
    "c3_drop_missing_rows_all",
    """SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax
       FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0""",
)
def c3_all(t):
    li = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
    )
    return rows.drop_missing_rows(li, ["l_discount", "l_tax"], "all")


def _delete(name, sql_keep, column, condition, value=None, case_sensitive=True):
    @query(
        f"c4_delete_rows_{name}",
        f"""WITH e AS (SELECT event_id, user_id, nullif(event_type, 'error') AS kind,
                         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS amount, ts FROM events)
            SELECT event_id, kind, amount FROM e WHERE {sql_keep}""",
    )
    def c4(t):
        e = t("events").select(
            "event_id",
            "user_id",
            F.nullif("event_type", F.lit("error")).alias("kind"),
            F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("amount"),
            "ts",
        )
        out = rows.delete_rows_condition(e, column, condition, value, case_sensitive)
        return out.select("event_id", "kind", "amount")


_delete("eq", "kind IS NULL OR kind <> 'click'", "kind", "==", "click")
_delete("ne_text", "kind IS NULL OR kind = 'click'", "kind", "ne", "click")
_delete("ne_number", "user_id = 7", "user_id", "!=", "7")
_delete("gt", "amount IS NULL OR amount <= 10", "amount", ">", 10)
_delete("lte", "user_id IS NULL OR user_id > 100", "user_id", "<=", "100")
_delete("ne_amount", "amount = 6.55", "amount", "ne", 6.55)
_delete("contains", "kind IS NULL OR NOT contains(lower(kind), 'ic')", "kind", "contains", "IC", False)
_delete("not_contains", "kind IS NOT NULL AND contains(kind, 'i')", "kind", "not_contains", "i")
_delete("starts_with", "kind IS NULL OR NOT starts_with(kind, 's')", "kind", "starts_with", "s")
_delete("ends_with", "kind IS NULL OR NOT ends_with(kind, 'w')", "kind", "ends_with", "w")
_delete("in", "kind IS NULL OR kind NOT IN ('view', 'click')", "kind", "in", "view, click")
_delete("not_in", "kind IS NOT NULL AND kind IN ('view', 'click')", "kind", "not_in", ["view", "click"])
_delete("is_null", "kind IS NOT NULL", "kind", "is_null")
_delete("is_not_null", "amount IS NULL", "amount", "is_not_null")
_delete("before", "ts >= TIMESTAMP '2024-01-10'", "ts", "lt", "2024-01-10")


@query(
    "c5_delete_rows",
    """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM events)
       WHERE i NOT IN (0, 1, 2, 17, 500)""",
)
def c5(t):
    out = rows.delete_rows(with_row_index(t("events"), ["ts"]), [0, 1, 2, "17", 500, -4])
    return out.select("event_id", "user_id")


@query(
    "c6_duplicate_rows",
    """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS i FROM events),
            d AS (SELECT event_id, i, 0 AS c FROM e UNION ALL SELECT event_id, i, 1 FROM e WHERE i IN (0, 5, 900))
       SELECT event_id, row_number() OVER (ORDER BY i, c) - 1 AS _row_index FROM d""",
)
def c6(t):
    out = rows.duplicate_rows(with_row_index(t("events").select("event_id", "ts"), ["ts"]), [0, 5, 900])
    return out.select("event_id", "_row_index")


@query(
    "c7_add_row",
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderpriority,
                         row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)
       SELECT CASE WHEN i >= 3 THEN i + 1 ELSE i END AS _row_index, o_orderkey, o_totalprice, o_orderpriority FROM o
       UNION ALL SELECT 3, 0, 12.5, NULL""",
)
def c7(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return rows.add_row(with_row_index(o, ["o_orderkey"]), {"o_orderkey": "0", "o_totalprice": "12.5"}, 3)


@query(
    "c8_update_cells",
    """WITH o AS (SELECT o_orderkey, o_totalprice, o_orderstatus,
                         row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_index FROM orders)
       SELECT _row_index, o_orderkey,
              CASE WHEN _row_index IN (1, 9) THEN NULL WHEN _row_index = 4 THEN 99.5 ELSE o_totalprice END AS o_totalprice,
              CASE WHEN _row_index = 4 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM o""",
)
def c8(t):
    o = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    updates = [
        {"row_index": 4, "column": "o_totalprice", "value": "99.5"},
        {"row_index": 4, "column": "o_orderstatus", "value": "X"},
        {"row_index": 1, "column": "o_totalprice", "value": None},
        {"row_index": 9, "column": "o_totalprice", "value": "n/a"},
        {"row_index": 10**12, "column": "o_totalprice", "value": 1},
    ]
    return rows.update_cells(with_row_index(o, ["o_orderkey"]), updates)


@query(
    "c9_remove_outliers_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
       SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
)
def c9(t):
    return rows.remove_outliers_iqr(t("events").select("event_id", "value"), "value")


@query(
    "c9_remove_outliers_zscore_clip",
    """WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
       SELECT event_id, round(least(greatest(value, m - 2 * s), m + 2 * s), 6) AS value FROM events, q""",
)
def c9_clip(t):
    out = rows.remove_outliers_iqr(t("events").select("event_id", "value"), "value", "z-score", "clip", z_threshold=2.0)
    return out.select("event_id", r6("value").alias("value"))


@query(
    "c10_head",
    """SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts) AS k FROM events) WHERE k <= 200""",
)
def c10(t):
    return rows.head(with_row_index(t("events"), ["ts"]), 200).select("event_id", "value")


@query(
    "c10_head_after_delete",
    """SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts) AS k FROM events WHERE value > 40) WHERE k <= 50""",
)
def c10_after(t):
    left = rows.delete_rows_condition(with_row_index(t("events"), ["ts"]), "value", "<=", 40)
    return rows.head(left, 50).select("event_id", "value")


@query(
    "c11_top_k",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12""",
)
def c11(t):
    return rows.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 12, ["o_orderkey"])


# ---- row order -----------------------------------------------------------

EVENTS = "(SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM events)"


def _events(t, *columns):
    return with_row_index(t("events").select("event_id", "ts", *columns), ["ts"])


@query(
    "h1_shift_column",
    """SELECT event_id, coalesce(lag(nullif(event_type, 'error'), 3) OVER (ORDER BY ts), 'none') AS kind_shift_down_3,
              lead(value, 2) OVER (ORDER BY ts) AS value_shift_up_2 FROM events""",
)
def h1(t):
    e = _events(t, F.nullif("event_type", F.lit("error")).alias("kind"), "value")
    down = ordered.shift_column(e, "kind", "lag", 3, fill_value="none")
    both = ordered.shift_column(down, "value", "up", 2)
    return both.select("event_id", "kind_shift_down_3", "value_shift_up_2")


@query(
    "h1_shift_after_delete",
    """SELECT event_id, lag(value, 2) OVER (ORDER BY ts) AS value_shift_down_2 FROM events WHERE event_type <> 'error'""",
)
def h1_after(t):
    left = rows.delete_rows_condition(_events(t, "value", "event_type"), "event_type", "eq", "error")
    return ordered.shift_column(left, "value", "down", 2).select("event_id", "value_shift_down_2")


@query(
    "h2_stats_rolling_mean",
    """SELECT event_id, CASE WHEN count(v) OVER w >= 4
                THEN round(avg(v) OVER w, 6) END AS v_roll_mean_7
       FROM (SELECT event_id, ts, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)
       WINDOW w AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def h2(t):
    e = _events(t, F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))
    out = ordered.stats_rolling_mean(e, "v", 7, min_periods=4)
    return out.select("event_id", r6("v_roll_mean_7").alias("v_roll_mean_7"))


def _h3_sql():
    parts = []
    for w in (3, 5, 10, 20):
        o = f"OVER (ORDER BY i ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        parts += [
            f"round(avg(value) {o}, 6) + 0 AS value_roll_mean_{w}",
            f"round(stddev_samp(value) {o}, 6) AS value_roll_std_{w}",
            f"round(var_samp(value) {o}, 6) AS value_roll_var_{w}",
            f"min(value) {o} AS value_roll_min_{w}",
            f"max(value) {o} AS value_roll_max_{w}",
            f"round(quantile_cont(value, 0.5) {o}, 6) AS value_roll_median_{w}",
            f"round(regr_slope(value, i) {o}, 6) + 0 AS value_roll_slope_{w}",
        ]
    return f"SELECT event_id, {', '.join(parts)} FROM {EVENTS}"


@query("h3_rolling_window_stats_nested", _h3_sql())
def h3(t):
    stats = "mean,std,var,min,max,median,slope"
    out = ordered.rolling_window_stats_nested(_events(t, "value"), "value", None, stats)
    names = [c for c in out.columns if "_roll_" in c]
    return out.select("event_id", *[r6(c).alias(c) for c in names])


@query(
    "h3_rolling_shape",
    f"""SELECT event_id,
          CASE WHEN count(value) OVER w >= 3 THEN round(skewness(value) OVER w, 4) + 0 END AS value_roll_skew_12,
          CASE WHEN count(value) OVER w >= 4 THEN round(kurtosis(value) OVER w, 4) + 0 END AS value_roll_kurt_12
        FROM {EVENTS} WINDOW w AS (ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def h3_shape(t):
    out = ordered.rolling_window_stats_nested(_events(t, "value"), "value", [12], ["skew", "kurt"])
    return out.select(
        "event_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("value_roll_skew_12", "value_roll_kurt_12")]
    )


def _h4_sql():
    """Tau-b by counting pairs of cells, all over SQL tables of counts."""
    return """
      WITH e AS (SELECT CAST(extract('hour' FROM o_orderdate) + 3 * month(o_orderdate) AS INT) AS x,
                        row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
           p AS (SELECT k.lag AS lag, e.x AS a, f.x AS b FROM range(1, 4) k(lag) JOIN e ON TRUE JOIN e f ON f.i = e.i - k.lag),
           c AS (SELECT lag, a, b, count(*) AS n FROM p GROUP BY ALL),
           g AS (SELECT u.lag, sum(CASE WHEN (u.a - v.a) * (u.b - v.b) > 0 THEN u.n * v.n
                                        WHEN (u.a - v.a) * (u.b - v.b) < 0 THEN -u.n * v.n ELSE 0 END) / 2 AS s
                 FROM c u JOIN c v ON u.lag = v.lag GROUP BY u.lag),
           m AS (SELECT lag, sum(n) AS n FROM c GROUP BY lag),
           ta AS (SELECT lag, sum(n * (n - 1)) / 2 AS t FROM (SELECT lag, a, sum(n) AS n FROM c GROUP BY lag, a) GROUP BY lag),
           tb AS (SELECT lag, sum(n * (n - 1)) / 2 AS t FROM (SELECT lag, b, sum(n) AS n FROM c GROUP BY lag, b) GROUP BY lag)
      SELECT CAST(g.lag AS INT) AS lag, CAST(m.n AS BIGINT) AS pairs,
             round(g.s / sqrt((m.n * (m.n - 1) / 2 - ta.t) * (m.n * (m.n - 1) / 2 - tb.t)), 6) + 0 AS tau
      FROM g JOIN m USING (lag) JOIN ta USING (lag) JOIN tb USING (lag)"""


@query("h4_significant_lags_kendall", _h4_sql())
def h4(t):
    o = t("orders").select("o_orderkey", (F.hour("o_orderdate") + 3 * F.month("o_orderdate")).alias("x"))
    table = ordered.kendall_lag_table(with_row_index(o, ["o_orderkey"]), "x", 1, 3)
    return table.select("lag", "pairs", r6("tau").alias("tau"))


def _h4_price_sql():
    """Tau-b of thousands of values; falling pairs counted among rows of one rank prefix, bit by bit."""
    return """
      WITH e AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS i FROM lineitem),
           c AS (SELECT lag, e.x AS a, f.x AS b FROM range(1, 3) k(lag) JOIN e ON TRUE JOIN e f ON f.i = e.i - k.lag),
           o AS (SELECT lag, a, b, row_number() OVER (PARTITION BY lag ORDER BY a, b) AS p, row_number() OVER (PARTITION BY lag ORDER BY b, a) - 1 AS r FROM c),
           w AS (SELECT lag, l, (r >> l) & 1 AS bit, sum((r >> l) & 1) OVER (PARTITION BY lag, l, r >> (l + 1) ORDER BY p) AS ones FROM o, range(0, 24) z(l)),
           d AS (SELECT lag, sum(ones) AS d FROM w WHERE bit = 0 GROUP BY lag),
           m AS (SELECT lag, count(*) AS n FROM c GROUP BY lag),
           ta AS (SELECT lag, sum(n * (n - 1)) / 2 AS t FROM (SELECT lag, a, count(*) AS n FROM c GROUP BY lag, a) GROUP BY lag),
           tb AS (SELECT lag, sum(n * (n - 1)) / 2 AS t FROM (SELECT lag, b, count(*) AS n FROM c GROUP BY lag, b) GROUP BY lag),
           tc AS (SELECT lag, sum(n * (n - 1)) / 2 AS t FROM (SELECT lag, a, b, count(*) AS n FROM c GROUP BY lag, a, b) GROUP BY lag)
      SELECT CAST(lag AS INT) AS lag, CAST(m.n AS BIGINT) AS pairs,
             round((m.n * (m.n - 1) / 2 - ta.t - tb.t + tc.t - 2 * d.d) / sqrt(m.n * (m.n - 1) / 2 - ta.t) / sqrt(m.n * (m.n - 1) / 2 - tb.t), 9) + 0 AS tau
      FROM m JOIN d USING (lag) JOIN ta USING (lag) JOIN tb USING (lag) JOIN tc USING (lag)"""


@query("h4_kendall_price", _h4_price_sql())
def h4_price(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = with_row_index(t("lineitem").select(*order, "l_extendedprice"), order, ["l_extendedprice"])
    table = ordered.kendall_lag_table(rows, "l_extendedprice", 1, 2)
    return table.select("lag", "pairs", (F.round("tau", 9) + F.lit(0.0)).alias("tau"))


@query(
    "h5_stats_percentile_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
              CASE WHEN v IS NOT NULL THEN round(
                (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)
                / (SELECT count(*) FROM lineitem WHERE l_discount <> 0), 6) END AS v_pct_rank
       FROM (SELECT *, nullif(l_discount, 0.0) AS v FROM lineitem)""",
)
def h5(t):
    li = t("lineitem").select(*LINEITEM_KEY, F.nullif("l_discount", F.lit(0.0)).alias("v"))
    return ordered.stats_percentile_rank(li, "v").select(*LINEITEM_KEY, r6("v_pct_rank").alias("v_pct_rank"))


@query(
    "h6_fill_forward",
    """SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v,
              last_value(k IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k
       FROM (SELECT event_id, ts, CASE WHEN event_id % 4 = 1 THEN value END AS v, nullif(event_type, 'error') AS k FROM events)""",
)
def h6(t):
    e = _events(t, F.when(F.col("event_id") % 4 == 1, F.col("value")).alias("v"), F.nullif("event_type", F.lit("error")).alias("k"))
    return fill_missing(e, strategy="ffill").select("event_id", "v", "k")


@query(
    "h6_fill_backward",
    """SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v
       FROM (SELECT event_id, ts, CASE WHEN event_id % 4 = 1 THEN value END AS v FROM events)""",
)
def h6_back(t):
    e = _events(t, F.when(F.col("event_id") % 4 == 1, F.col("value")).alias("v"))
    return fill_missing(e, "v", "bfill").select("event_id", "v")


@query(
    "h7_row_index",
    """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS _row_index,
              l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity <= 25""",
)
def h7(t):
    li = with_row_index(t("lineitem").select(*LINEITEM_KEY, "l_quantity"), LINEITEM_KEY)
    kept = reindex(rows.delete_rows_condition(li, "l_quantity", ">", 25))
    return kept.select("_row_index", "l_orderkey", "l_linenumber", "l_partkey")


# ---- joins and comparisons -------------------------------------------------


def _join(how, kind):
    @query(
        f"j1_join_on_keys_{how}",
        f"""WITH a AS (SELECT s_suppkey AS k, nullif(s_nationkey, 3) AS nk, s_name AS name FROM supplier),
                 b AS (SELECT nullif(n_nationkey, 5) AS key, n_name AS name, n_regionkey FROM nation WHERE n_nationkey <> 7)
            SELECT k, nk, a.name AS name, key, b.name AS name_src, n_regionkey
            FROM a {kind} JOIN b ON nk IS NOT DISTINCT FROM key""",
    )
    def j1(t):
        a = t("supplier").select(
            F.col("s_suppkey").alias("k"), F.nullif("s_nationkey", F.lit(3)).alias("nk"), F.col("s_name").alias("name")
        )
        b = t("nation").filter("n_nationkey <> 7").select(
            F.nullif("n_nationkey", F.lit(5)).alias("key"), F.col("n_name").alias("name"), "n_regionkey"
        )
        return joins.join_on_keys(a, b, ["nk"], ["key"], how)


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join(_how, _kind)


@query(
    "j1_join_large",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderpriority, c_mktsegment
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
)
def j1_large(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = t("customer").select("c_custkey", "c_mktsegment")
    both = joins.join_on_keys(li, o, ["l_orderkey"], ["o_orderkey"])
    return joins.join_on_keys(both, c, ["o_custkey"], ["c_custkey"]).drop("o_orderkey", "c_custkey")


@query(
    "j2_append",
    """SELECT c_custkey AS key, c_name AS name, CAST(c_acctbal AS DOUBLE) AS acctbal, c_mktsegment, NULL AS region FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, NULL FROM supplier
       UNION ALL SELECT n_nationkey, n_name, NULL, NULL, CAST(n_regionkey AS VARCHAR) FROM nation
       UNION ALL SELECT r_regionkey, r_name, NULL, NULL, r_name FROM region""",
)
def j2(t):
    c = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    s = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    n = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    g = t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.col("r_name").alias("region"))
    return joins.append(c, [s, n, g])


def _versions(t):
    before = with_row_index(t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), ["o_orderkey"])
    after = before.withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice"))
    )
    after = after.filter(F.col("_row_index") % 50 != 49)
    return before, after


VERSIONS = """b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderkey, o_totalprice, o_orderstatus FROM orders),
              a AS (SELECT i, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
                           o_orderstatus FROM b WHERE i % 50 <> 49)"""


@query(
    "j3_diff",
    f"""WITH {VERSIONS}
        SELECT b.i AS row_index, CASE WHEN a.i IS NULL THEN 'removed' ELSE 'changed' END AS change,
               b.o_totalprice AS old_price, a.o_totalprice AS new_price
        FROM b LEFT JOIN a ON a.i = b.i WHERE a.i IS NULL OR a.o_totalprice IS DISTINCT FROM b.o_totalprice""",
)
def j3(t):
    changes = joins.diff(*_versions(t))
    return changes.select(
        "row_index", "change", F.col("before.o_totalprice").alias("old_price"), F.col("after.o_totalprice").alias("new_price")
    )


@query("j4_apply_patch", f"WITH {VERSIONS} SELECT i AS _row_index, o_orderkey, o_totalprice, o_orderstatus FROM a")
def j4(t):
    before, after = _versions(t)
    return joins.apply_patch(before, joins.diff(before, after), "forward")


@query("j4_apply_patch_back", f"WITH {VERSIONS} SELECT i AS _row_index, o_orderkey, o_totalprice, o_orderstatus FROM b")
def j4_back(t):
    before, after = _versions(t)
    return joins.apply_patch(after, joins.diff(before, after), "backward")
