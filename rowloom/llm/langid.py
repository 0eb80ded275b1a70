"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of the characters of its words, up to ``ORDER`` at a
time, over all character groups of its training texts. Counts, continuation
counts, discounts and totals are aggregates; the probabilities and the weights
of the shorter groups stand in sorted hash arrays, one for each range of
hashes, so a model may outgrow every executor.

Only distinct groups are looked up: those of all texts meet the arrays of
their ranges, which gives the bits of each group in each language. Texts then
add up the bits of their groups: of the commonest ones from a table of at most
``COMMON_BYTES`` that every task holds, of all others by a join of (text,
group).

A text belongs to the language of least cross-entropy per character. Texts
that are held out of a second set of models, a fourth of the training texts, are
scored by those to choose the sharpness of the score and, per language, the entropy
above which a text is marked as rejected.

Cases: texts that are null or have no letter are ``und`` with score 0; ties
go to the first language in order; rows with null text or language teach
nothing; with nothing to learn from, all texts are ``und``; repeated rows and
ids are scored each; other columns are ignored, whatever their names. Groups are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.textnum import mix, pieces
from rowloom.session import materialize, scratch

ORDER = 5
UNKNOWN = "und"
#: Share of training texts of a language whose entropy may lie above its limit.
REJECTED = 0.001
SHARPNESS = [0.5, 1, 2, 4, 8, 16, 32, 64]
#: Bound on the table of common groups in every task, with its index; it decides how groups are looked up, not what is found.
COMMON_BYTES = 8 << 20
#: Bytes of the index for a key, at most.
INDEX_BYTES = 16
#: Keys in one range of hashes, on average.
RANGE_KEYS = 200_000
#: Texts taken together.
PIECE_CHARS = 4 << 20
#: Code points looked at together, whatever text they are of.
BLOCK = 1 << 20
#: No letter has a code point from here on.
TOP = 0x40000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code points that are letters as they are, others as 0; and a random number for each code point and place."""
    letters = np.fromiter((i if chr(i).isalpha() else 0 for i in range(TOP)), np.uint32, TOP)
    keys = np.arange(ORDER * TOP, dtype=np.uint64).reshape(ORDER, TOP)
    return letters, mix(mix(keys + np.uint64(0x9E3779B97F4A7C15)))


def hashes(grams: list[np.ndarray]) -> np.ndarray:
    """Tabulation hash of groups, given as their code points by distance from the end."""
    keys = _tables()[1]
    h = keys[0][grams[0]]
    for k in range(1, ORDER):
        h ^= keys[k][grams[k]]
    return h


def windows(texts: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Blocks of groups of the texts' words and, for each block, the number of the first group of each text and the end.

    A word is a run of letters of the lower-cased text with blanks around it;
    a group ends at each letter and at the blank behind the word. A group
    gives, by distance from its end, code points, 0 for a blank.
    """
    lows = [t.lower() for t in texts]
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lows), np.int64, len(lows)) + 1)])
    points = np.frombuffer((" " * (ORDER - 1) + " ".join(lows) + " ").encode("utf-32-le"), np.uint32)
    for lo in range(0, int(ends[-1]), BLOCK):
        part = _tables()[0][np.minimum(points[lo : lo + BLOCK + ORDER - 1], TOP - 1)]
        back = [part[ORDER - 1 - k : len(part) - k] for k in range(ORDER)]
        at = np.flatnonzero((back[0] != 0) | (back[1] != 0))
        grams = [x[at] for x in back]
        for k in range(2, ORDER):  # nothing from before the word
            grams[k] *= grams[k - 1] != 0
        yield grams, np.searchsorted(at, ends - lo)


def distinct_grams(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct groups, a row of code points each, and their counts."""
    seen = np.zeros(TOP, bool)
    for x in grams:
        seen[x] = True
    seen[0] = True
    alphabet, number = np.flatnonzero(seen).astype(np.uint32), np.cumsum(seen) - 1
    bits = int(len(alphabet) - 1).bit_length()
    if bits * ORDER > 63:
        _, first, n = np.unique(hashes(grams), return_index=True, return_counts=True)
        return np.stack([x[first] for x in grams[::-1]], 1), n
    packed = number[grams[0]]
    for k in range(1, ORDER):
        packed |= number[grams[k]] << (bits * k)
    packed, n = np.unique(packed, return_counts=True)
    places = [alphabet[packed >> (bits * k) & ((1 << bits) - 1)] for k in range(ORDER - 1, -1, -1)]
    return np.stack(places, 1), n


def _in_pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    return pieces(np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]), PIECE_CHARS)


def count_grams(docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Texts to counts (by, gram, h, n) of their groups of characters; ``h`` is the group's hash."""
    kinds = "".join(f"{n} {docs.schema[n].dataType.simpleString()}, " for n in by)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[str]] = {}
            for group, text in zip(zip(*(batch[n].to_pylist() for n in by)) if by else [()] * batch.num_rows, batch["text"]):
                if text.is_valid:
                    groups.setdefault(group, []).append(text.as_py())
            for group, texts in groups.items():
                found = [distinct_grams(grams) for lo, hi in _in_pieces(texts) for grams, _ in windows(texts[lo:hi])]
                grams, times = np.concatenate([g for g, _ in found]), np.concatenate([n for _, n in found])
                if not len(grams):
                    continue
                h, first, number = np.unique(hashes(list(grams.T[::-1])).view(np.int64), return_index=True, return_inverse=True)
                chars = np.where(grams[first] == 0, np.uint32(32), grams[first])
                text = chars.tobytes().decode("utf-32-le")
                names = pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)])
                own = [pa.array([g] * len(h), batch.schema.field(c).type) for g, c in zip(group, by)]
                n = np.bincount(number, times, len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*own, names, pa.array(h), pa.array(n)], [*by, "gram", "h", "n"])

    parts = docs.select(*by, "text").mapInArrow(work, f"{kinds}gram string, h bigint, n bigint")
    return parts.groupBy(*by, "gram", "h").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in order, the code points each may meet, and the sorted hash arrays of all of them.

    ``store`` has a row for each range of hashes: the keys in order, and for
    each key one number per language.
    """

    langs: list[str]
    letters: list[int]
    store: DataFrame
    ranges: int


def _key(kind: str, order: int | Column, gram: Column) -> Column:
    """Hash of a group (``own``) or of what stands before a character (``back``)."""
    order = F.lit(order) if isinstance(order, int) else order
    return F.xxhash64(F.lit(kind), order.cast("int"), gram)


def _range(ranges: int) -> Column:
    return F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(ranges).cast("long"), 31).cast("int")


def _packed(part: pa.Table) -> pa.Table:
    keys = part["key"].to_numpy()
    order = np.argsort(keys)
    values = part["values"].combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
    arrays = [pa.array([x.tobytes()], pa.binary()) for x in (keys[order], values[order])]
    return pa.Table.from_arrays([part["range"].slice(0, 1), *arrays], ["range", "keys", "values"])


def build_model(counts: DataFrame) -> Model:
    """Interpolated Kneser-Ney models from counts (lang, gram, n) of groups of ``ORDER``."""
    level = counts.where("n > 0").select("lang", "gram", "n")
    levels = level.withColumn("order", F.lit(ORDER))
    for order in range(ORDER - 1, 0, -1):  # how many different characters come before
        level = level.groupBy("lang", F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))
        levels = levels.unionByName(level.withColumn("order", F.lit(order)))
    levels = materialize(levels)
    once, twice = (F.count_if(F.col("n") == k) for k in (1, 2))
    discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75)
    facts = materialize(levels.groupBy("order", "lang").agg(discount.alias("discount"), F.count("*").alias("size")))
    sizes = {r["lang"]: r["size"] for r in facts.where("order = 1").collect()}
    langs = sorted(sizes)
    kept = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0))
    rows = levels.join(F.broadcast(facts), ["order", "lang"])  # five rows a language
    rows = rows.select("order", "lang", "gram", "n", kept.alias("kept"), F.expr("left(gram, order - 1)").alias("before"))
    same = Window.partitionBy("order", "lang", "before")  # at most one row per code point
    rows = rows.withColumn("total", F.sum("n").over(same))
    own = rows.select(_key("own", F.col("order"), F.col("gram")).alias("key"), "lang", (F.col("kept") / F.col("total")).alias("value"), F.lit(0.0).alias("other"))
    back = rows.groupBy("order", "lang", "before").agg((1 - F.sum("kept") / F.first("total")).alias("value"))
    back = back.select(_key("back", F.col("order"), F.col("before")).alias("key"), "lang", "value", F.lit(1.0).alias("other"))
    each = [F.coalesce(F.max(F.when(F.col("lang") == x, F.col("value"))), F.first("other")) for x in langs]
    wide = materialize(own.unionByName(back).groupBy("key").agg(F.array(*each).cast("array<double>").alias("values")))
    ranges = max(1, -(-wide.count() // RANGE_KEYS))
    store = wide.withColumn("range", _range(ranges)).groupBy("range").applyInArrow(_packed, "range int, keys binary, values binary")
    return Model(langs, [sizes[x] + 1 for x in langs], materialize(store), ranges)


def look_up(keys: DataFrame, model: Model) -> DataFrame:
    """(key, values) of the distinct ``keys`` that the model has."""

    def work(asked: pa.Table, arrays: pa.Table) -> pa.Table:
        wanted = asked["key"].to_numpy()
        if not arrays.num_rows:
            wanted, have, values = wanted[:0], np.zeros(1, np.int64), np.zeros((1, 1))
        else:
            have = np.frombuffer(arrays["keys"][0].as_py(), np.int64)
            values = np.frombuffer(arrays["values"][0].as_py()).reshape(len(have), -1)
        at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
        hit = have[at] == wanted
        found = values[at[hit]]
        lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
        return pa.Table.from_arrays([pa.array(wanted[hit]), lists], ["key", "values"])

    keys = materialize(keys)
    # More keys than the model has: each range is asked in slices, of which every one gets the arrays.
    slices = max(1, -(-keys.count() // (model.ranges * 2 * RANGE_KEYS)))
    asked = keys.withColumn("range", _range(model.ranges)).withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    store = model.store.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    both = asked.groupBy("range", "slice").cogroup(store.groupBy("range", "slice"))
    return both.applyInArrow(work, "key bigint, values array<double>")


def gram_bits(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, h, n) to (h, n, bits): the cost of the last character after the others in each language."""
    places = [(kind, order) for order in range(1, ORDER + 1) for kind in ("own", "back")]
    tail = lambda kind, order: F.expr(f"right(gram, {order})" if kind == "own" else f"left(right(gram, {order}), {order - 1})")
    keys = F.array(*(_key(kind, order, tail(kind, order)) for kind, order in places))
    asked = grams.select("h", "n", F.posexplode(keys).alias("place", "key"))
    found = asked.join(look_up(asked.select("key").distinct(), model), "key", "left")
    each = found.groupBy("h").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("place") == i, F.col("values"))).alias(f"v{i}") for i in range(len(places))))
    fill = lambda x: F.array_repeat(F.lit(x), len(model.langs))
    p = F.array(*(F.lit(1.0 / n) for n in model.letters))
    for i in range(0, len(places), 2):
        weighted = F.zip_with(F.coalesce(f"v{i + 1}", fill(1.0)), p, lambda a, b: a * b)
        p = F.zip_with(F.coalesce(f"v{i}", fill(0.0)), weighted, lambda a, b: a + b)
    return each.select("h", "n", F.transform(p, lambda x: -F.log2(F.greatest(x, F.lit(1e-9)))).alias("bits"))


def _common(costs: DataFrame, langs: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and costs of the commonest groups, as many as fit; groups of like counts go together."""
    size = F.floor(F.log2("n") * 8).cast("int")
    left, least = room // (8 + 4 * langs + INDEX_BYTES), None
    for r in sorted(costs.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros((0, langs), np.float32)
    table = costs.where(size >= least).select("h", F.col("bits").cast("array<float>").alias("bits")).toArrow()
    keys = table["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["bits"].combine_chunks().flatten().to_numpy().reshape(len(keys), langs)[order]


class _Sorted:
    """Places of hashes in a sorted array, found from the first key of each of many even ranges."""

    def __init__(self, keys: np.ndarray):
        width = max(1, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - width)
        self.first = np.searchsorted(keys, np.arange(1 << width, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.size = len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or the number of keys where there is none."""
        at = self.first[h >> self.shift]
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < h[behind]]
        at[self.keys[at] != h] = self.size
        return at


def entropies(docs: DataFrame, model: Model, keep: tuple[str, ...], room: int = COMMON_BYTES, costs: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Adds ``bits``: cross-entropy per character in each language of the model, null without letters.

    ``costs`` are the ``gram_bits`` of at least the groups of ``docs``, if they
    are known; ``names`` some of the model's languages, neighbours in its order.
    """
    spark, names = docs.sparkSession, names or model.langs
    langs = len(names)
    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in keep)
    with scratch(spark) as scope:
        if costs is None:
            costs = materialize(gram_bits(materialize(count_grams(docs)), model))
        costs = costs.withColumn("bits", F.slice("bits", model.langs.index(names[0]) + 1, langs))
        shared = spark.sparkContext.broadcast(_common(costs, langs, room))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, values = shared.value
            common, values = _Sorted(have), np.vstack([values, np.zeros((1, langs), np.float32)])
            for batch in batches:
                texts = [t or "" for t in batch["text"].to_pylist()]
                for lo, hi in _in_pieces(texts):
                    yield piece(batch.slice(lo, hi - lo), texts[lo:hi], common, values)

        def piece(part: pa.RecordBatch, texts: list[str], common: _Sorted, values: np.ndarray) -> pa.RecordBatch:
            rows = len(texts)
            size, sums, rare = np.zeros(rows), np.zeros((rows, langs)), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for grams, begin in windows(texts):
                h = hashes(grams)
                at = common.find(h)
                some = np.flatnonzero(np.diff(begin))
                if len(some):
                    size[some] += np.diff(begin)[some]
                    sums[some] += np.add.reduceat(values[at], begin[some], axis=0, dtype=np.float64)
                    other = np.flatnonzero(at == common.size)
                    rare.append((np.searchsorted(begin, other, "right") - 1, h[other]))
            where, which = (np.concatenate(x) for x in zip(*rare))
            order = np.lexsort((which, where))
            where, which = where[order], which[order]
            first = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (which[1:] != which[:-1])])) if len(where) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(where)))
            others = pa.StructArray.from_arrays([pa.array(which[first].view(np.int64)), pa.array(times, pa.int64())], ["h", "times"])
            ends = np.searchsorted(where[first], np.arange(rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * langs, sums.ravel())
            return pa.RecordBatch.from_arrays(
                [*(part[c] for c in keep), lists, pa.array(size), pa.ListArray.from_arrays(ends, others)], [*keep, "sums", "size", "rare"]
            )

        schema = f"{kinds}, sums array<double>, size double, rare array<struct<h: bigint, times: bigint>>"
        parts = docs.select(*keep, "text").mapInArrow(work, schema)
        parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()))
        more = parts.select("row", F.inline("rare")).join(costs, "h")
        more = more.groupBy("row").agg(F.array(*(F.sum(F.col("times") * F.col("bits")[i]) for i in range(langs))).alias("more"))
        total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
        bits = F.when(F.col("size") > 0, F.transform(total, lambda x: x / F.col("size")))
        return scope.keep(materialize(parts.join(more, "row", "left").select(*keep, bits.alias("bits"))))


def _share(best: Column, sharpness: float) -> Column:
    """Softmax of the negative entropies at the least one."""
    return 1.0 / F.aggregate("bits", F.lit(0.0), lambda acc, b: acc + F.exp((best - b) * sharpness))


@dataclass
class Identifier:
    """``model`` has each language twice: by all texts (``+``) and, as far as there are any, by those not held (``-``).

    ``costs`` are the bits of the groups of all texts that ``learn`` was given.
    """

    model: Model | None
    sharpness: float
    limits: dict[str, float]
    costs: DataFrame | None = None

    @property
    def langs(self) -> list[str]:
        return _named(self.model, "+") if self.model else []


def _named(model: Model, mark: str) -> list[str]:
    return [x[1:] for x in model.langs if x[0] == mark]


def learn(docs: DataFrame, held: Column, text_col: str = "text", lang_col: str = "lang", taught: Column | None = None) -> Identifier:
    """Models from all rows, or those that are ``taught``; ``held`` marks those that the calibrating models must not see.

    Rows that are not taught are only counted, so that ``identify`` need not
    read and look up the groups of the same table again.
    """
    lang = F.col(lang_col).cast("string")
    lang = lang if taught is None else F.when(taught, lang)
    rows = docs.select(lang.alias("lang"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    sharpness, limits = 8.0, {}
    with scratch(docs.sparkSession) as scope:
        n, rest = F.sum("n").alias("n"), F.sum(F.when(~F.col("held"), F.col("n")).otherwise(0)).alias("n_rest")
        counts = materialize(count_grams(rows, ("lang", "held")).groupBy("lang", "gram", "h").agg(n, rest))
        taught, rows = counts.where("lang IS NOT NULL"), rows.where("lang IS NOT NULL")
        if taught.isEmpty():
            return Identifier(None, sharpness, limits)
        either = [F.struct(F.concat(F.lit(mark), "lang").alias("lang"), "gram", F.col(c).alias("n")) for mark, c in (("+", "n"), ("-", "n_rest"))]
        model = build_model(taught.select(F.inline(F.array(*either))))
        scope.keep(model.store)
        costs = scope.keep(materialize(gram_bits(counts.groupBy("gram", "h").agg(n), model)))
        part = _named(model, "-")
        if part:
            langs = F.array(*(F.lit(x) for x in part))
            scored = entropies(rows.where("held"), model, ("lang",), costs=costs, names=["-" + x for x in part]).where("bits IS NOT NULL")
            best = F.array_min("bits")
            true = F.col("bits")[(F.array_position(langs, F.col("lang")) - 1).cast("int")]
            known = scored.where(F.array_contains(langs, F.col("lang")))
            loss = [F.avg(-F.log(F.greatest(F.exp((best - true) * s) * _share(best, s), F.lit(1e-9)))) for s in SHARPNESS]
            row = known.agg(*(x.alias(str(i)) for i, x in enumerate(loss))).first()
            if row[0] is not None:
                sharpness = float(SHARPNESS[min(range(len(SHARPNESS)), key=lambda i: row[i])])
            for r in known.groupBy("lang").agg(F.percentile_approx(true, 1 - REJECTED, 10_000).alias("limit")).collect():
                limits[r["lang"]] = r["limit"]
    return Identifier(model, sharpness, limits, costs)


def identify(docs: DataFrame, fitted: Identifier, id_col: str = "doc_id", text_col: str = "text", room: int = COMMON_BYTES, costs: DataFrame | None = None) -> DataFrame:
    """(id_col, lang_pred, score, entropy, rejected) of every row; ``costs`` as for ``entropies``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not fitted.langs:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    scored = entropies(rows, fitted.model, ("id",), room, costs, ["+" + x for x in fitted.langs])
    best = F.array_min("bits")
    langs = F.array(*(F.lit(x) for x in fitted.langs))
    number = F.array_position("bits", best).cast("int")
    limits = F.array(*(F.lit(float(fitted.limits.get(x, float("inf")))) for x in fitted.langs))
    has = F.col("bits").isNotNull()
    return scored.select(
        F.col("id").alias(id_col),
        F.when(has, F.element_at(langs, number)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(has, F.least(_share(best, fitted.sharpness), F.lit(1.0))).otherwise(0.0).alias("score"),
        best.alias("entropy"),
        F.when(has, best > F.element_at(limits, number)).otherwise(True).alias("rejected"),
    )
