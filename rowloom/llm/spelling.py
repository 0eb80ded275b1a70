"""Spelling variant grouping with a frequency-vector trie.

Words are arranged by the numbers of letters that they have of successive
letter groups, after their length: each number is one level of a trie, and a
leaf holds the words of one vector. Words that differ by one inserted, deleted
or replaced character have vectors that differ by at most one surplus and one
deficit, so a depth-first search with a budget of one each visits all their
leaves, and the words found there are compared themselves. A search runs for
words of the same length and, one surplus more, for words one longer; the
other direction is the same pair.

The upper levels of the trie are tables: a node whose words are too many for
one task is opened, and words and searches move on to its children, until the
subtrees are small. Each subtree then meets the searches that reach it in
blocks of bounded size. A subtree that is one vector and still too large is
split into blocks that every search of it visits.

Cases: null texts have no words, a null id is an empty one; rows of one id and
text count as often as they stand there; ties of the most frequent near word
go to the smallest in code-point order; words without near words are their
own root; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letter groups of the trie's levels, in order; all other characters are the last group.
GROUPS = ("e", "n", "t", "i", "r", "a", "o", "s", "h", "u", "c", "l", "d", "mg", "bp", "fvw", "kqjxyz")
#: Bytes of words in one subtree, and searches (or words of one vector) in one block of it.
SUBTREE_BYTES = 1 << 20
BLOCK_WORDS = 100_000
#: Searches that are expanded at once, and bytes of words compared at once.
FRONT, COMPARED = 1 << 17, 1 << 23


def vocabulary(docs: DataFrame, id_col: str, text_col: str, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of all texts, some occurrences with a character deleted as their hash says."""
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{shortest},}})"), F.lit(1))
    each = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = each.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def vector(word: Column) -> Column:
    """Length and letter-group counts, the last group left out: the others fix it."""
    size = F.char_length(word)
    return F.array(size, *(size - F.char_length(F.translate(word, g, "")) for g in GROUPS))


_GROUP_OF = np.full(256, len(GROUPS), np.int64)
for _i, _g in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _g]] = _i


def matrix(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letter-group counts of the words of a matrix."""
    at = _GROUP_OF[rows] + np.arange(len(rows))[:, None] * (len(GROUPS) + 1)
    return np.bincount(at.ravel(), minlength=len(rows) * (len(GROUPS) + 1)).reshape(len(rows), -1)


class Trie:
    """Words sorted by their vectors; level l has a node for every distinct run of l counts."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        counts = counts[self.order]
        self.most = int(counts.max(initial=0))
        self.span = self.most + 1
        node = np.zeros(len(counts), np.int64)
        self.levels = []
        for l in range(counts.shape[1]):
            keys, node = np.unique(node * self.span + counts[:, l], return_inverse=True)
            self.levels.append(keys)
        self.first = np.searchsorted(node, np.arange(len(self.levels[-1]) + 1))

    def search(self, counts: np.ndarray, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves within the budget: (search, leaf) in pieces, depth first by blocks of searches."""
        start = np.arange(len(counts))
        stack = [(0, start, np.zeros(len(start), np.int64), np.full(len(start), surplus), np.full(len(start), deficit))]
        while stack:
            level, who, node, up, down = stack.pop()
            if level == len(self.levels):
                yield who, node
                continue
            if len(who) > FRONT:
                half = len(who) // 2
                stack += [(level, *(x[half:] for x in (who, node, up, down))), (level, *(x[:half] for x in (who, node, up, down)))]
                continue
            keys, have = self.levels[level], counts[who, level]
            parts = []
            for step, may in ((0, np.ones(len(who), bool)), (1, up > 0), (-1, down > 0)):
                at = np.flatnonzero(may & (have + step <= self.most) & (have + step >= 0))
                key = node[at] * self.span + have[at] + step
                child = np.searchsorted(keys, key)
                hit = np.flatnonzero(child < len(keys))
                hit = hit[keys[child[hit]] == key[hit]]
                at = at[hit]
                parts.append((who[at], child[hit], up[at] - (step == 1), down[at] - (step == -1)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by one replaced character, or by one more in ``long``."""
    if short.shape[1] == long.shape[1]:
        return np.count_nonzero(short != long, axis=1) == 1
    size = short.shape[1]
    front, back = short == long[:, :-1], (short == long[:, 1:])[:, ::-1]
    lead = np.where(front.all(1), size, np.argmin(front, 1))
    trail = np.where(back.all(1), size, np.argmin(back, 1))
    return lead + trail >= size


def near_pairs(home: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, word) of all pairs that differ by one edit; queries as long as the words or one shorter."""
    trie = Trie(vectors(home))
    found = []
    step = max(1, COMPARED // max(1, home.shape[1]))
    for who, leaf in trie.search(vectors(queries), 1, int(home.shape[1] == queries.shape[1])):
        sizes = trie.first[leaf + 1] - trie.first[leaf]
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(who):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
            part = sizes[lo:hi]
            q = np.repeat(who[lo:hi], part)
            w = trie.order[np.repeat(trie.first[leaf[lo:hi]], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)]
            same = one_edit(queries[q], home[w])
            found.append((q[same], w[same]))
            lo = hi
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _summed(words: np.ndarray, near: np.ndarray, n: np.ndarray) -> pa.Table:
    """Per word: how many near words, and the most frequent of them (ties: the smallest)."""
    order = np.lexsort((near, -n, words))
    words, near, n = words[order], near[order], n[order]
    head = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(words)))
    return pa.table({"word": pa.array(words[head], pa.string()), "n_near": pa.array(sizes, pa.int64()), "near": pa.array(near[head], pa.string()), "near_n": pa.array(n[head], pa.int64())})


def _search(home: pa.Table, visits: pa.Table) -> pa.Table:
    """Searches of one subtree: partial sums for the words of both sides."""
    words, n = np.array(home["word"].to_pylist(), object), home["n"].to_numpy()
    parts = [_summed(np.zeros(0, object), np.zeros(0, object), np.zeros(0, np.int64))]
    longer = visits["longer"].to_numpy(zero_copy_only=False)
    for flag in (False, True):
        part = visits.filter(pa.array(longer == flag))
        if not part.num_rows or not len(words):
            continue
        asked, asked_n = np.array(part["word"].to_pylist(), object), part["n"].to_numpy()
        q, w = near_pairs(matrix(words.tolist()), matrix(asked.tolist()))
        if not flag:  # the other order of such a pair is found too
            once = asked[q] < words[w]
            q, w = q[once], w[once]
        parts.append(_summed(np.concatenate([asked[q], words[w]]), np.concatenate([words[w], asked[q]]), np.concatenate([n[w], asked_n[q]])))
    return pa.concat_tables(parts)


def _reaching(rows: DataFrame, steps: Column) -> DataFrame:
    """Searches (word, n, v, longer, up, down, path) moved on by each affordable step."""
    moved = rows.withColumn("step", F.explode(steps)).where("step <= up AND -step <= down")
    return moved.withColumns({"up": F.col("up") - F.greatest("step", F.lit(0)), "down": F.col("down") - F.greatest(-F.col("step"), F.lit(0))})


def near_words(vocab: DataFrame, subtree_bytes: int = SUBTREE_BYTES, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, near, near_n) of the words of (word, n) that have a word at one edit: the most frequent such."""
    steps = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    home = vocab.select("word", "n", vector(F.col("word")).alias("v")).withColumn("path", F.col("v")[0].cast("string"))
    same = home.select("word", "n", "v", F.lit(False).alias("longer"), F.lit(1).alias("up"), F.lit(1).alias("down"), "path")
    more = home.select("word", "n", "v", F.lit(True).alias("longer"), F.lit(1).alias("up"), F.lit(0).alias("down"), (F.col("v")[0] + 1).cast("string").alias("path"))
    visits = same.unionByName(more)
    homes, searches = [], []
    for level in range(1, len(GROUPS) + 2):
        nodes = home.groupBy("path").agg(F.sum(F.col("v")[0]).alias("bytes"))
        last = level == len(GROUPS) + 1
        nodes = materialize(nodes.select("path", ((F.col("bytes") > subtree_bytes) & F.lit(not last)).alias("open")))
        homes.append(home.join(nodes.where("NOT open"), "path", "left_semi").select("path", "word", "n"))
        searches.append(visits.join(nodes.where("NOT open"), "path", "left_semi").select("path", "word", "n", "longer"))
        if last or nodes.where("open").isEmpty():
            break
        count = F.col("v")[level]
        home = home.join(nodes.where("open"), "path", "left_semi").withColumn("path", F.concat_ws(",", "path", count))
        visits = _reaching(visits.join(nodes.where("open"), "path", "left_semi"), steps)
        visits = materialize(visits.withColumn("path", F.concat_ws(",", "path", count + F.col("step"))).drop("step"))
        home = materialize(home)
    union = lambda frames: materialize(frames[0] if len(frames) == 1 else _all(frames))
    home, visits = union(homes), union(searches)
    sizes = home.groupBy("path").agg(F.count("*").alias("words")).join(visits.groupBy("path").agg(F.count("*").alias("asked")), "path")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int")
    sizes = materialize(sizes.select("path", blocks("words").alias("h"), blocks("asked").alias("q")))
    mine = F.pmod(F.xxhash64("word"), F.col("h")).cast("int").alias("hb")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = home.join(sizes, "path").select("path", "word", "n", mine, every("q").alias("qb"))
    asked = F.pmod(F.xxhash64("word", F.lit(1)), F.col("q")).cast("int").alias("qb")
    right = visits.join(sizes, "path").select("path", "word", "n", "longer", asked, every("h").alias("hb"))
    keys = ["path", "hb", "qb"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search, "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best")
    summed = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return summed.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n"))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words of (word, form) with a form: the end of the chain. Each form is ten times as frequent, so chains are short."""
    step = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        jump = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(step.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        step = new.select("word", "root")
        if new.where("moved").isEmpty():
            return step


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    The form of a word is its most frequent near word, if that is at least
    ``ratio`` times as frequent; the root is reached by following forms.
    """
    vocab = materialize(vocabulary(docs, id_col, text_col))
    near = near_words(vocab)
    joined = vocab.join(near, "word", "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    found = joined.select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")
    )
    found = materialize(found)
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
