"""Column, date, arithmetic, scaling and binning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators import binning, columns, datemath, scaling
from rowloom.queries.book import LINEITEM_KEY, query, r6

KEY_SQL = ", ".join(LINEITEM_KEY)


@query("d1_rename_column", "SELECT c_custkey AS customer, c_name FROM customer")
def d1(t):
    return columns.rename_column(t("customer").select("c_custkey", "c_name"), "c_custkey", "customer")


@query("d2_delete_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def d2(t):
    return columns.delete_columns(t("customer"), ["c_name", "c_acctbal", "nothing"])


@query(
    "d3_duplicate_column",
    "SELECT c_custkey, c_name, c_name AS c_name_copy, c_name AS c_name_copy_2 FROM customer",
)
def d3(t):
    once = columns.duplicate_column(t("customer").select("c_custkey", "c_name"), "c_name")
    return columns.duplicate_column(once, "c_name")


@query(
    "d4_derive_column",
    f"""SELECT {KEY_SQL},
          round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
          l_quantity > 25 AND l_returnflag IN ('A', 'R') AS flagged,
          CAST(floor(l_quantity / 7) AS DOUBLE) AS sevens,
          round(l_quantity - 7 * floor(l_quantity / 7), 6) AS rest,
          round(pow(l_quantity, 2) + sin(l_tax), 6) AS mixed,
          round(l_quantity - (SELECT avg(l_quantity) FROM lineitem), 6) + 0 AS centred
        FROM lineitem""",
)
def d4(t):
    df = t("lineitem")
    formulas = {
        "charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)",
        "flagged": "l_quantity > 25 and l_returnflag in ['A', 'R']",
        "sevens": "l_quantity // 7",
        "rest": "`l_quantity` % 7",
        "mixed": "l_quantity ** 2 + sin(l_tax)",
        "centred": "l_quantity - l_quantity.mean()",
    }
    for name, text in formulas.items():
        df = columns.derive_column(df, name, text)
    rounded = [r6(c).alias(c) if c not in {"flagged"} else F.col(c) for c in formulas]
    return df.select(*LINEITEM_KEY, *rounded)


MESSY = """CASE event_id % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN '  ' || CAST(user_id AS VARCHAR) || ' ' WHEN 2 THEN '1e2'
           WHEN 3 THEN '0x1F' WHEN 4 THEN 'yes' ELSE 'FALSE' END"""


def _messy(t):
    n = F.col("event_id") % 6
    return t("events").select(
        "event_id",
        F.when(n == 0, "n/a")
        .when(n == 1, F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" ")))
        .when(n == 2, "1e2")
        .when(n == 3, "0x1F")
        .when(n == 4, "yes")
        .otherwise("FALSE")
        .alias("m"),
    )


@query(
    "d5_cast_column",
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN CAST(user_id AS DOUBLE) WHEN 2 THEN 100.0 END AS as_number,
              CASE event_id % 6 WHEN 4 THEN TRUE WHEN 5 THEN FALSE WHEN 1 THEN
                   CASE user_id WHEN 1 THEN TRUE WHEN 0 THEN FALSE END END AS as_flag,
              CAST(event_id AS VARCHAR) AS as_text FROM events""",
)
def d5(t):
    m = _messy(t)
    for name in ("as_number", "as_flag"):
        m = columns.duplicate_column(m, "m", name)
    m = columns.duplicate_column(m, "event_id", "as_text")
    m = columns.cast_column(m, "as_number", "numeric")
    m = columns.cast_column(m, "as_flag", "boolean")
    return columns.cast_column(m, "as_text", "string").drop("m")


GAPPY = """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v, nullif(event_type, 'error') AS k FROM events"""


def _gappy(t):
    return t("events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"), F.nullif("event_type", F.lit("error")).alias("k")
    )


@query("d6_fill_missing_value", f"SELECT event_id, coalesce(v, 0.5) AS v, k FROM ({GAPPY})")
def d6_value(t):
    return columns.fill_missing(_gappy(t), "v", "value", 0.5)


@query(
    "d6_fill_missing_mean",
    f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM ({GAPPY}))), 6) AS v FROM ({GAPPY})",
)
def d6_mean(t):
    return columns.fill_missing(_gappy(t), "v", "mean").select("event_id", r6("v").alias("v"))


@query(
    "d6_fill_missing_median",
    f"SELECT event_id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM ({GAPPY}))), 6) AS v FROM ({GAPPY})",
)
def d6_median(t):
    return columns.fill_missing(_gappy(t), "v", "median").select("event_id", r6("v").alias("v"))


@query(
    "d6_fill_missing_mode",
    f"""WITH g AS ({GAPPY})
        SELECT event_id,
          coalesce(v, (SELECT v FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v,
          coalesce(k, (SELECT k FROM g WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)) AS k FROM g""",
)
def d6_mode(t):
    return columns.fill_missing(_gappy(t), None, "mode")


@query(
    "d7_replace_values",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus,
              regexp_replace(o_orderpriority, '^(\\d)-(\\w+)', '\\2/\\1') AS o_orderpriority FROM orders""".replace("\\\\", "\\"),
)
def d7(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    whole = columns.replace_values(o, "o", "open", "o_orderstatus", case_sensitive=False)
    return columns.replace_values(whole, r"^(\d)-(\w+)", r"\2/\1", "o_orderpriority", regex=True)


@query(
    "d7_replace_in_pages",
    r"""SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS html, url FROM pages""",
)
def d7_pages(t):
    return columns.replace_values(t("pages"), r"<[^>]*>", "", "html", regex=True)


@query(
    "d8_split_column",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second FROM part""",
)
def d8(t):
    p = t("part").select("p_partkey", "p_name")
    return columns.split_column(p, "p_name", " ", 1, ["first", "second"], drop_original=True)


@query(
    "d9_merge_columns",
    """SELECT p_partkey, concat_ws('-', trim(p_brand), CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END,
              nullif(trim(p_type), 'SMALL')) AS tag FROM part""",
)
def d9(t):
    p = t("part").select(
        "p_partkey",
        F.concat(F.lit(" "), "p_brand").alias("b"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("s"),
        F.when(F.col("p_type") == "SMALL", "  ").otherwise(F.col("p_type")).alias("y"),
    )
    return columns.merge_columns(p, ["b", "s", "y"], "tag", "-", drop_source=True)


@query(
    "d10_trim_whitespace",
    r"""SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents""",
)
def d10(t):
    return columns.trim_whitespace(t("documents").select("doc_id", F.concat(F.lit(" \t"), "text", F.lit("\n ")).alias("text")), "text")


@query(
    "d11_normalize_text_case",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low,
              list_aggregate(list_transform(regexp_extract_all(p_type || ' o''neil 3rd', '[a-zA-Z]+|[^a-zA-Z]+'),
                  lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') AS title FROM part""",
)
def d11(t):
    p = t("part").select(
        "p_partkey", F.col("p_name").alias("up"), F.col("p_brand").alias("low"), F.concat("p_type", F.lit(" o'neil 3rd")).alias("title")
    )
    for name, case in (("up", "upper"), ("low", "lower"), ("title", "title")):
        p = columns.normalize_text_case(p, name, case)
    return p


@query(
    "d12_encode_one_hot",
    """SELECT o_orderkey, coalesce(k = 'F', FALSE) AS k_F, coalesce(k = 'P', FALSE) AS k_P, k IS NULL AS k_nan
       FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS k FROM orders)""",
)
def d12(t):
    o = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("k"))
    return columns.encode_categorical(o, "k", "one_hot")


@query(
    "d13_encode_label",
    """SELECT o_orderkey, dense_rank() OVER (ORDER BY coalesce(k, '__MISSING__')) - 1 AS k
       FROM (SELECT o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS k FROM orders)""",
)
def d13(t):
    o = t("orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("k"))
    return columns.encode_categorical(o, "k", "label")


@query("d14_clip_values", "SELECT c_custkey, CASE WHEN b < 0 THEN 0 WHEN b > 5000 THEN 5000 ELSE b END AS b FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS b FROM customer)")
def d14(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("b"))
    return columns.clip_values(c, "b", 0, "5000")


@query(
    "d15_unit_convert",
    """SELECT p_partkey, p_size, round(p_size::DOUBLE * 0.3048 / 0.01, 6) AS p_size_cm, round(p_retailprice * 9 / 5 + 32, 6) AS hot,
              round(p_size::DOUBLE * 3.785411784, 6) AS p_size_l FROM part""",
)
def d15(t):
    p = t("part").select("p_partkey", "p_size", "p_retailprice")
    p = columns.unit_convert(p, "p_size", "Feet", "Centimetres")
    p = columns.unit_convert(p, "p_size", "US gallons", "litre", "volume")
    p = columns.unit_convert(p, "p_retailprice", "Celsius", "°F", new_name="hot")
    return p.select("p_partkey", "p_size", r6("p_size_cm").alias("p_size_cm"), r6("hot").alias("hot"), r6("p_size_l").alias("p_size_l"))


# ---- dates and arithmetic ----------------------------------------------------


@query(
    "e1_extract_date_part",
    """SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS mo, weekofyear(ts) AS w, day(ts) AS d,
              isodow(ts) - 1 AS dow, hour(ts) AS h, minute(ts) AS mi FROM events""",
)
def e1(t):
    df = t("events").select("event_id", "ts")
    for name, part in zip(("y", "q", "mo", "w", "d", "dow", "h", "mi"), ("year", "quarter", "month", "week", "day", "dayofweek", "hour", "minute")):
        df = datemath.extract_date_part(df, "ts", part, name)
    return df.drop("ts").select("event_id", *[F.col(c).cast("long").alias(c) for c in ("y", "q", "mo", "w", "d", "dow", "h", "mi")])


@query(
    "e2_date_diff_days",
    """SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 86400000000.0) AS BIGINT) AS gap,
              CAST(floor((epoch_us(ts) - epoch_us(date_trunc('day', ts) + INTERVAL 10 HOUR)) / 86400000000.0) AS BIGINT) AS part FROM events""",
)
def e2(t):
    df = t("events").select("event_id", "ts", (F.date_trunc("day", "ts") + F.expr("INTERVAL 10 HOURS")).cast("timestamp_ntz").alias("ref"))
    df = datemath.date_diff_days(df, "ts", reference_date="2024-01-15 12:00:00", new_name="gap")
    return datemath.date_diff_days(df, "ts", reference_column="ref", new_name="part").select("event_id", "gap", "part")


@query(
    "e3_datetime_floor",
    """SELECT event_id, date_trunc('day', ts) AS d, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w,
              CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS mi FROM events""".replace(
        "date_trunc('day', ts) AS d", "CAST(date_trunc('day', ts) AS TIMESTAMP) AS d"
    ),
)
def e3(t):
    df = t("events").select("event_id", "ts")
    for name, unit in (("d", "day"), ("w", "week"), ("m", "month"), ("h", "hour"), ("mi", "minute")):
        df = datemath.datetime_floor(df, "ts", unit, name)
    return df.drop("ts")


@query(
    "e4_cyclical_encoding",
    """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS h_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0 AS h_cos,
              round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0 AS d_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0 AS d_cos,
              round(sin(2 * pi() * (value - 1) / 10), 6) + 0 AS v_sin, round(cos(2 * pi() * (value - 1) / 10), 6) + 0 AS v_cos
       FROM events""",
)
def e4(t):
    df = t("events").select("event_id", "ts", "value")
    df = datemath.cyclical_encoding(df, "ts", "hour_of_day", prefix="h")
    df = datemath.cyclical_encoding(df, "ts", "day_of_week", prefix="d")
    df = datemath.cyclical_encoding(df, "value", "raw", period=10, offset=1, prefix="v")
    return df.select("event_id", *[r6(f"{p}_{f}").alias(f"{p}_{f}") for p in "hdv" for f in ("sin", "cos")])


@query(
    "e5_math_scalar",
    """SELECT p_partkey, p_size::DOUBLE + 2.5 AS a, p_size::DOUBLE - 2.5 AS s, p_size::DOUBLE * 2.5 AS m, round(p_size / 4.0, 6) AS d,
              round(pow(p_size, 1.5), 6) AS p FROM part""",
)
def e5(t):
    df = t("part").select("p_partkey", "p_size")
    for name, op, k in (("a", "add", 2.5), ("s", "subtract", 2.5), ("m", "multiply", 2.5), ("d", "divide", 4), ("p", "power", 1.5)):
        df = datemath.math_scalar(df, "p_size", op, k, name)
    return df.select("p_partkey", "a", "s", "m", r6("d").alias("d"), r6("p").alias("p"))


@query(
    "e6_math_unary",
    """SELECT c_custkey, abs(b) AS f_abs, CASE WHEN b >= 0 THEN round(sqrt(b), 6) END AS f_sqrt,
              CASE WHEN b > 0 THEN round(ln(b), 6) + 0 END AS f_log, CASE WHEN b > 0 THEN round(log10(b), 6) + 0 END AS f_log10,
              round(exp(b / 1000), 6) AS f_exp, round_even(b / 100, 1) + 0 AS f_round,
              CAST(floor(b) AS BIGINT) AS f_floor, CAST(ceil(b) AS BIGINT) AS f_ceil, -b AS f_negate
       FROM (SELECT c_custkey, c_acctbal AS b FROM customer)""",
)
def e6(t):
    df = t("customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    for f in ("abs", "sqrt", "log", "log10", "floor", "ceil", "negate"):
        df = datemath.math_unary(df, "b", f, new_name=f"f_{f}")
    df = datemath.math_scalar(df, "b", "divide", 1000, "k")
    df = datemath.math_unary(df, "k", "exp", new_name="f_exp")
    df = datemath.math_scalar(df, "b", "divide", 100, "h")
    df = datemath.math_unary(df, "h", "round", 1, "f_round")
    out = [r6(f"f_{f}").alias(f"f_{f}") for f in ("sqrt", "log", "log10", "exp")]
    whole = [F.col(c).cast("long").alias(c) for c in ("f_floor", "f_ceil")]
    return df.select("c_custkey", "f_abs", *out, (F.col("f_round") + F.lit(0.0)).alias("f_round"), *whole, "f_negate")


@query(
    "e7_math_between_columns",
    f"""SELECT {KEY_SQL}, l_quantity + l_tax AS a, l_quantity - l_tax AS s, round(l_quantity * l_tax, 6) AS m,
               round(l_quantity / nullif(l_discount, 0), 6) AS d FROM lineitem""",
)
def e7(t):
    df = t("lineitem").select(*LINEITEM_KEY, "l_quantity", "l_tax", "l_discount")
    for name, other, op in (("a", "l_tax", "add"), ("s", "l_tax", "subtract"), ("m", "l_tax", "multiply"), ("d", "l_discount", "divide")):
        df = datemath.math_between_columns(df, "l_quantity", other, op, name)
    return df.select(*LINEITEM_KEY, "a", "s", r6("m").alias("m"), r6("d").alias("d"))


# ---- scaling ---------------------------------------------------------------

BALANCES = "(SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS b FROM customer)"

_SCALES = {
    "f1_min_max_scaling": ("min_max_scaling", "b_minmax", {}, "(b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())"),
    "f2_max_absolute_scaling": ("max_absolute_scaling", "b_maxabs", {}, "b / max(abs(b)) OVER ()"),
    "f3_mean_normalization": (
        "mean_normalization", "b_mean_norm", {}, "(b - avg(b) OVER ()) / (max(b) OVER () - min(b) OVER ())",
    ),
    "f4_unit_vector_scaling": ("unit_vector_scaling", "b_unit_vector", {}, "b / sqrt(sum(b * b) OVER ())"),
    "f5_decimal_scaling": (
        "decimal_scaling", "b_decimal_scaled", {}, "b / pow(10, greatest(1, ceil(log10(max(abs(b)) OVER ()))))",
    ),
    "f6_z_score_scaling": ("z_score_scaling", "b_zscaled", {}, "(b - avg(b) OVER ()) / stddev_samp(b) OVER ()"),
    "f7_robust_scaling": (
        "robust_scaling", "b_robust", {},
        "(b - quantile_cont(b, 0.5) OVER ()) / (quantile_cont(b, 0.75) OVER () - quantile_cont(b, 0.25) OVER ())",
    ),
    "f8_log_scaling": ("log_scaling", "b_log", {"base": "10"}, "log10(b + abs(min(b) OVER ()) + 1)"),
    "f8_log_scaling_custom": (
        "log_scaling", "b_log", {"base": "2", "shift_mode": "custom", "shift": 10},
        "CASE WHEN b + 10 > 0 THEN log2(CASE WHEN b + 10 > 0 THEN b + 10 END) END",
    ),
}


def _scaled(name, method, column, params, sql):
    @query(name, f"SELECT c_custkey, round({sql}, 6) + 0 AS {column} FROM {BALANCES}")
    def f(t):
        c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("b"))
        return scaling.scale(c, method, "b", **params).select("c_custkey", r6(column).alias(column))


for _name, (_method, _column, _params, _sql) in _SCALES.items():
    _scaled(_name, _method, _column, _params, _sql)


def _f9_sql():
    return f"""
      WITH n AS (SELECT count(b) AS n FROM {BALANCES}),
           refs AS (SELECT unnest(range(0, 100)) AS i,
                    unnest((SELECT quantile_cont(b, {[i / 99.0 for i in range(100)]}) FROM {BALANCES})) AS q),
           placed AS (SELECT c_custkey, b, (SELECT max(i) FROM refs WHERE q <= b) AS lo, (SELECT min(i) FROM refs WHERE q >= b) AS hi
                      FROM {BALANCES})
      SELECT c_custkey, CASE WHEN b IS NULL THEN NULL WHEN hi <= lo THEN round((lo + hi) / 2.0 / 99, 6)
             ELSE round((lo + (b - a.q) / (c.q - a.q)) / 99, 6) END AS b_quantile
      FROM placed LEFT JOIN refs a ON a.i = lo LEFT JOIN refs c ON c.i = hi"""


@query("f9_quantile_transform", _f9_sql())
def f9(t):
    c = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 13 != 0, F.col("c_acctbal")).alias("b"))
    return scaling.scale(c, "quantile_transform", "b", n_quantiles=100).select("c_custkey", r6("b_quantile").alias("b_quantile"))


@query("f9_quantile_transform_normal")
def f9_normal(t):
    c = t("customer").select("c_custkey", F.col("c_acctbal").alias("b"))
    out = scaling.scale(c, "quantile_transform", "b", output_distribution="normal")
    return out.select("c_custkey", r6("b_quantile").alias("b_quantile"))


# ---- binning ---------------------------------------------------------------


def _bin_summary(df, value, label):
    """Counts and ends of every bin; a label maps to one such row."""
    return df.groupBy(label).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    ).drop(label)


@query(
    "g1_equal_width",
    """WITH m AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders),
            p AS (SELECT o_totalprice AS v, greatest(1, ceil((o_totalprice - a) / (b - a) * 6)) AS bin FROM orders, m)
       SELECT count(*) AS n, min(v) AS low, max(v) AS high FROM p GROUP BY bin""",
)
def g1(t):
    out = binning.auto_binning(t("orders"), "o_totalprice", "equal_width", 6)
    return _bin_summary(out, "o_totalprice", "o_totalprice_binned")


@query(
    "g2_equal_frequency",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b,
                         quantile_cont(o_totalprice, 0.75) AS c FROM orders),
            p AS (SELECT o_totalprice AS v, CASE WHEN o_totalprice <= a THEN 1 WHEN o_totalprice <= b THEN 2
                         WHEN o_totalprice <= c THEN 3 ELSE 4 END AS bin FROM orders, q)
       SELECT count(*) AS n, min(v) AS low, max(v) AS high FROM p GROUP BY bin""",
)
def g2(t):
    out = binning.auto_binning(t("orders"), "o_totalprice", "quantile", 4)
    return _bin_summary(out, "o_totalprice", "o_totalprice_binned")


@query("g3_kmeans")
def g3(t):
    out = binning.auto_binning(t("orders"), "o_totalprice", "kmeans", 4)
    return _bin_summary(out, "o_totalprice", "o_totalprice_binned")


def _jenks_sql(rows: str, k: int) -> str:
    """Least squared deviation of the distinct values ``v`` (n rows each) in k classes, tried over all starts of the last class."""
    layers = "".join(
        f""", d{g} AS (SELECT j.pos, min(i.c + CASE WHEN i.pos < j.pos THEN greatest(j.q - i.q - (j.s - i.s) * (j.s - i.s) / (j.n - i.n), 0) END) AS c
                       FROM p j JOIN (SELECT p.*, d{g - 1}.c FROM p JOIN d{g - 1} USING (pos)) i ON i.pos < j.pos AND i.pos >= {g - 1} GROUP BY j.pos)"""
        for g in range(2, k + 1)
    )
    return f"""WITH w AS ({rows}), h AS (SELECT v, count(*)::double AS n FROM w WHERE v IS NOT NULL GROUP BY v),
         p AS (SELECT row_number() OVER o AS pos, sum(n) OVER o AS n, sum(n * (v - m)) OVER o AS s, sum(n * (v - m) * (v - m)) OVER o AS q
               FROM h, (SELECT avg(v) AS m FROM w) WINDOW o AS (ORDER BY v)),
         d1 AS (SELECT pos, q - s * s / n AS c FROM p){layers}
         SELECT round(log2(c), 6) AS cost FROM d{k} WHERE pos = (SELECT max(pos) FROM p)"""


def _deviation(rows, v, label):
    """Squared deviation of the rows of all bins from the bins' means, as a logarithm."""
    centre = rows.agg(F.avg(v)).first()[0] or 0.0
    x = F.col(v) - F.lit(centre)
    each = rows.where(F.col(v).isNotNull()).groupBy(label).agg((F.sum(x * x) - F.sum(x) * F.sum(x) / F.count("*")).alias("q"))
    return each.agg(F.round(F.log2(F.sum("q")), 6).alias("cost"))


@query("g4_jenks", _jenks_sql("SELECT CAST(floor(o_totalprice / 200) AS DOUBLE) AS v FROM orders", 4))
def g4(t):
    rows = t("orders").select(F.floor(F.col("o_totalprice") / 200).cast("double").alias("v"))
    return _deviation(binning.auto_binning(rows, "v", "jenks", 4), "v", "v_binned")


@query("g4_jenks_price", "SELECT CAST(count(DISTINCT l_extendedprice) AS BIGINT) AS held, 4 AS bins, TRUE AS best FROM lineitem")
def g4_price(t):
    """Breaks of thousands of values: no break may gain from a move to a neighbouring value."""
    rows = t("lineitem").select(F.col("l_extendedprice").alias("v"))
    edges = binning.bin_edges(rows, "v", "jenks", 4)
    own = rows.select("v", F.expr(" + ".join(f"int(v > {e!r})" for e in edges[1:-1])).alias("bin"))
    bins = own.groupBy("bin").agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).alias("b")
    after = bins.select((F.col("bin") - 1).alias("bin"), F.col("m").alias("m2"), F.col("n").alias("n2"), F.col("low").alias("low2"))
    # Moving one value to the other side changes the cost by its weighed distances to both means.
    keep = lambda x, m1, n1, m2, n2: F.pow(F.col(x) - F.col(m1), 2) * F.col(n1) / (F.col(n1) - 1) <= F.pow(F.col(x) - F.col(m2), 2) * F.col(n2) / (F.col(n2) + 1) * (1 + 1e-12)
    pairs = bins.join(after, "bin")
    held = pairs.agg(F.bool_and(keep("high", "m", "n", "m2", "n2") & keep("low2", "m2", "n2", "m", "n")).alias("best"), (F.count("*") + 1).cast("int").alias("bins"))
    return rows.agg(F.countDistinct("v").alias("held")).join(F.broadcast(held)).select("held", "bins", "best")


LATE = "CASE WHEN l_quantity + l_linenumber > 30 THEN 'y' ELSE 'n' END"


def _tree_sql(rows: str, leaves: int, entropy: bool = False) -> str:
    """Bins of a best-first tree on (v, y): in each round all cuts of all leaves are scored from class counts."""
    grow = "({0}) * log2(greatest({0}, 1))" if entropy else "({0}) * ({0})"
    impurity = f"({grow.format('{n}')} - {{q}})" if entropy else "({n} - {q} / {n})"
    side = lambda n, q: impurity.replace("{n}", n).replace("{q}", q)
    out = f"""WITH w AS ({rows}), ks AS (SELECT DISTINCT y FROM w), vs AS (SELECT DISTINCT v FROM w),
      h AS (SELECT vs.v, ks.y, coalesce(g.n, 0)::double AS n FROM vs, ks LEFT JOIN (SELECT v, y, count(*) AS n FROM w GROUP BY ALL) g ON g.v = vs.v AND g.y = ks.y),
      l0 AS (SELECT '-inf'::double AS lo, 'inf'::double AS hi)"""
    for i in range(leaves - 1):
        out += f""",
      c{i} AS (SELECT lo, hi, v, y, sum(n) OVER (PARTITION BY lo, y ORDER BY v) AS c, sum(n) OVER (PARTITION BY lo, y) AS t FROM h JOIN l{i} ON v > lo AND v <= hi),
      s{i} AS (SELECT lo, hi, v, sum(c) AS nl, sum(t - c) AS nr, sum({grow.format('c')}) AS ql, sum({grow.format('t - c')}) AS qr, sum(t) AS n, sum({grow.format('t')}) AS q FROM c{i} GROUP BY ALL),
      b{i} AS (SELECT lo, hi, v, {side('n', 'q')} - {side('nl', 'ql')} - {side('nr', 'qr')} AS gain FROM s{i} WHERE nr > 0 ORDER BY round(gain, 6) DESC, lo, v LIMIT 1),
      l{i + 1} AS (SELECT l.lo, l.hi FROM l{i} l, b{i} b WHERE l.lo <> b.lo UNION ALL SELECT lo, v FROM b{i} UNION ALL SELECT v, hi FROM b{i})"""
    return out + f" SELECT count(*) AS n, min(v) AS low, max(v) AS high FROM w JOIN l{leaves - 1} ON v > lo AND v <= hi GROUP BY lo"


def _tree(t, column, method, target):
    rows = t("lineitem").select(F.col(column).alias("v"), F.expr(target).alias("y"))
    return _bin_summary(binning.auto_binning(rows, "v", method, 4, target_column="y"), "v", "v_binned")


for _n, _m, _c, _y in (
    ("g5_decision_tree", "tree", "l_quantity", LATE),
    ("g7_mdlp", "mdlp", "l_quantity", LATE),
    ("g5_decision_tree_price", "tree", "l_extendedprice", "l_returnflag || l_linestatus"),
    ("g7_mdlp_price", "mdlp", "l_extendedprice", "CASE WHEN l_discount < 0.05 THEN l_returnflag ELSE l_linestatus END"),
):
    query(_n, _tree_sql(f"SELECT {_c} AS v, {_y} AS y FROM lineitem", 4, _m == "mdlp"))(lambda t, c=_c, m=_m, y=_y: _tree(t, c, m, y))


@query("g6_chimerge")
def g6(t):
    li = t("lineitem").withColumn("late", F.expr(LATE))
    out = binning.auto_binning(li, "l_quantity", "chimerge", 4, target_column="late")
    return _bin_summary(out, "l_quantity", "l_quantity_binned")


@query(
    "g8_domain_threshold",
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 'low' WHEN o_totalprice <= 100000 THEN 'mid' ELSE 'high' END AS band,
              CASE WHEN o_totalprice <= 50000 THEN 'bin_1' ELSE 'bin_2' END AS half FROM orders""",
)
def g8(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    o = binning.auto_binning(o, "o_totalprice", "domain", thresholds="1000, 100000", labels="low,mid,high", new_name="band")
    return binning.auto_binning(o, "o_totalprice", "thresholds", thresholds=[50000], new_name="half").drop("o_totalprice")


@query(
    "g9_bin_numeric_categories",
    """SELECT p_partkey, CASE WHEN p_size < 5 THEN 'tiny' WHEN p_size BETWEEN 5 AND 20 THEN 'small'
              WHEN p_size >= 40 THEN 'big' ELSE 'other' END AS p_size_category FROM part""",
)
def g9(t):
    rules = "<5:tiny\n0-20:small\n>=40:big\nnot a rule"
    out = binning.bin_numeric_categories(t("part").select("p_partkey", "p_size"), "p_size", rules_text=rules, default_label="other")
    return out.drop("p_size")
