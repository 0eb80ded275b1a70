"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

The statistics of a text become a short vector. For each group of language and
source a minimum-covariance-determinant estimate gives centre and scatter of
the better half of its rows, and rows at a large Mahalanobis distance go. The
concentration steps are aggregates: distances are counted in narrow bins with
sums of the vectors and their products, so the half of least distance is read
off running sums and no group, however large, meets in one task.

Cases: null or empty texts have no words and fail the limits; null language
and source are values of their own; groups with fewer than ``least`` usable
rows share one estimate per language; scatter has a floor, so equal rows do
not make any difference infinite; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import textnum as T
from rowloom.session import materialize

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
PIECE = 256 << 10
REPEAT = 5

#: Statistic, and the least standard deviation that it is given.
VECTOR = [("v0", 0.15), ("v1", 0.04), ("v2", 0.15), ("v3", 0.10)]
_V = [n for n, _ in VECTOR]
#: Squared distance above which a row goes: the chi-square quantile of 1 - 1e-5 with four degrees of freedom.
LIMIT = 28.47
BINS_PER_OCTAVE = 16
GRID = 512


def repeated_words(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words inside an ``n``-word window that occurs twice in its row."""
    mask = np.zeros(len(values), bool)
    counts = np.maximum(rows[1:] - rows[:-1] - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return mask
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + rows[:-1][row]
    key = T.mix(T.Rolling(values, T.BASE_A).of(at, at + n) + T.mix(row.astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(total, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = at[twice]
    for j in range(n):
        mask[starts + j] = True
    return mask


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep…, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of every row."""
    kinds = {n: docs.schema[n].dataType.simpleString() for n in keep}
    kind = docs.schema[id_col].dataType.simpleString()

    def per_row(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[edges[1:]] - sums[edges[:-1]]

    def lines(text: bytes) -> tuple[int, int]:
        found = [x for x in text.split(b"\n") if x and not x.isspace()]
        return len(found), len(found) - len(set(found))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.raw(batch["text"])
            for lo, hi in T.pieces(offsets, PIECE):
                part, edges = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, rows = T.word_bounds(part, edges)
                chars = ~T._IS_SPACE[part] & ((part & 0xC0) != 0x80)
                again = repeated_words(T.word_values(part, starts, ends), rows, REPEAT)
                whole = part.tobytes()
                counted = [lines(whole[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                columns = [rows[1:] - rows[:-1], per_row(chars, edges), per_row(_IS_SYMBOL[part], edges), np.array([c[1] for c in counted]),
                           per_row(again, rows), np.array([c[0] for c in counted])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[n].slice(lo, hi - lo) for n in ("id", *(f"k{i}" for i in range(len(keep))))), *(pa.array(c.astype(np.int64)) for c in columns)],
                    ["id", *(f"k{i}" for i in range(len(keep))), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
                )

    plain = docs.select(F.col(id_col).alias("id"), *(F.col(n).alias(f"k{i}") for i, n in enumerate(keep)), F.col(text_col).alias("text"))
    schema = ", ".join([f"id {kind}", *(f"k{i} {kinds[n]}" for i, n in enumerate(keep)), "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"])
    return plain.mapInArrow(work, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    """Transformed statistics: log of the mean word length, and shares of symbols, repeated lines and repeated words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log(chars / words), F.col("n_symbols") / chars, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / words]


def _start(rows: DataFrame) -> DataFrame:
    """Median and scaled median deviation of every statistic per group, exact on a fine grid."""
    cell = lambda c: F.round(c * GRID).cast("long")
    long = rows.select("g", F.posexplode(F.array(*_V)).alias("j", "x"))

    def middle(cells: DataFrame) -> DataFrame:
        counted = cells.groupBy("g", "j", "cell").agg(F.count("*").alias("n"))
        w = Window.partitionBy("g", "j")
        upto = F.sum("n").over(w.orderBy("cell"))
        return counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(w)).where("2 * upto >= all").groupBy("g", "j").agg((F.min("cell") / GRID).alias("m"))

    centre = materialize(middle(long.select("g", "j", cell(F.col("x")).alias("cell"))))
    away = long.join(centre, ["g", "j"]).select("g", "j", cell(F.abs(F.col("x") - F.col("m"))).alias("cell"))
    spread = middle(away).withColumnRenamed("m", "s")
    both = centre.join(spread, ["g", "j"])
    return both.groupBy("g").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda x: x["m"]).alias("mean"),
        F.transform(F.sort_array(F.collect_list(F.struct("j", "s"))), lambda x: x["s"]).alias("spread"),
    )


_FIT = "g string, mean array<double>, inverse array<double>, logdet double"


def _solve(sums: DataFrame) -> DataFrame:
    """Mean and inverse scatter per group, from (g, n, share, s, p): rows, their share of the group, sums and sums of products."""
    floor = np.array([s for _, s in VECTOR]) ** 2
    d = len(floor)
    upper = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch["n"].to_numpy().astype(float)
            mean = np.array(batch["s"].to_pylist(), float) / n[:, None]
            scatter = np.zeros((len(n), d, d))
            scatter[:, upper[0], upper[1]] = np.array(batch["p"].to_pylist(), float) / n[:, None]
            scatter[:, upper[1], upper[0]] = scatter[:, upper[0], upper[1]]
            scatter -= mean[:, :, None] * mean[:, None, :]
            # The inner half of a normal group looks narrower than the group; the factor for half of four dimensions.
            scatter *= np.where(batch["share"].to_numpy() < 0.75, 1.64, 1.0)[:, None, None]
            scatter += np.diag(floor)
            inverse, logdet = np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]
            yield pa.RecordBatch.from_arrays(
                [batch["g"], pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(inverse.reshape(len(n), -1).tolist(), pa.list_(pa.float64())), pa.array(logdet)],
                ["g", "mean", "inverse", "logdet"],
            )

    return sums.mapInArrow(work, _FIT)


def _distance() -> Column:
    away = [F.col(v) - F.col("mean")[i] for i, v in enumerate(_V)]
    terms = [away[i] * away[j] * F.col("inverse")[i * len(_V) + j] for i in range(len(_V)) for j in range(len(_V))]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _concentrate(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One step: the estimate from the half of each group with the least distances under ``fit``."""
    bin_ = F.floor(F.log2(_distance() + 1e-6) * BINS_PER_OCTAVE)
    pairs = [(i, j) for i in range(len(_V)) for j in range(i, len(_V))]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(_V)] + [F.sum(F.col(_V[i]) * F.col(_V[j])).alias(f"p{i}_{j}") for i, j in pairs]
    binned = rows.join(fit, "g").groupBy("g", bin_.alias("bin")).agg(F.count("*").alias("n"), *sums)
    w = Window.partitionBy("g")
    upto = F.sum("n").over(w.orderBy("bin"))
    inner = binned.withColumn("all", F.sum("n").over(w)).withColumn("before", upto - F.col("n")).where(f"2 * before < all + {len(_V) + 1}")
    names = [f"s{i}" for i in range(len(_V))], [f"p{i}_{j}" for i, j in pairs]
    total = inner.groupBy("g").agg(F.sum("n").alias("n"), F.max("all").alias("all"), *(F.sum(c).alias(c) for c in names[0] + names[1]))
    return _solve(total.select("g", "n", (F.col("n") / F.col("all")).alias("share"), F.array(*names[0]).alias("s"), F.array(*names[1]).alias("p")))


def fit_groups(rows: DataFrame, most_steps: int = 8) -> DataFrame:
    """(g, v0…) to (g, mean, inverse, logdet): concentration steps from a robust start until no determinant falls."""
    start = _start(rows)
    inverse = F.flatten(
        F.array(*(F.array(*((1.0 / (F.pow(1.4826 * F.col("spread")[i], 2) + VECTOR[i][1] ** 2)) if i == j else F.lit(0.0) for j in range(len(_V)))) for i in range(len(_V))))
    )
    fit = materialize(start.select("g", "mean", inverse.alias("inverse"), F.lit(float("inf")).alias("logdet")))
    for _ in range(most_steps):
        new = materialize(_concentrate(rows, fit))
        fell = new.select("g", "logdet").join(fit.select("g", F.col("logdet").alias("was")), "g").where("was - logdet > 1e-3")
        fit, done = new, fell.isEmpty()
        if done:
            break
    return fit


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 50, limit: float = LIMIT
) -> DataFrame:
    """Statistics and verdict of every row: (id_col, n_words, …, base_failed, distance, kept)."""
    stats = statistics(docs, id_col, text_col, (lang_col, source_col)).withColumn("base_failed", base_failed())
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    stats = stats.withColumns(dict(zip(_V, _vector())))
    stats = materialize(stats.withColumn("own", F.concat_ws("\x1f", part("k0"), part("k1"))).withColumn("rest", F.concat_ws("\x1f", part("k0"), F.lit("*"))))
    usable = stats.where(~F.col("base_failed"))
    sizes = materialize(usable.groupBy("own").agg(F.count("*").alias("usable")))
    grouped = stats.join(sizes, "own", "left").withColumn("g", F.when(F.col("usable") >= least, F.col("own")).otherwise(F.col("rest")))
    grouped = materialize(grouped.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "g", *_V))
    fit = fit_groups(grouped.where(~F.col("base_failed")).select("g", *_V))
    judged = grouped.join(fit, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= limit)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance"
    )
