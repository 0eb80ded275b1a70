"""Density clusters of low-dimensional points, exact and without point pairs
between crowded places.

Space is cut into cells of diagonal ``eps``, so points of one cell are always
neighbours. A cell of at least ``min_samples`` points is dense: all its points
are core and none needs a distance. Points of other cells are few per cell by
definition; each cell carries the bounded list of such points around it, and
every point is compared with that list only. Two dense cells touch if any of
their points do; that is settled on the bounding boxes of ever finer sub-cells,
never on point pairs. Clusters are the connected components of the cells.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.guards import ParameterError, number, quoted, require
from rowloom.operators.ordering import running_total
from rowloom.operators.skew import lookup
from rowloom.session import materialize

MAX_DIMENSIONS = 3


def _reach(dims: int) -> list[tuple[int, ...]]:
    """Offsets of the cells that may hold a point within ``eps``."""
    far = math.ceil(math.sqrt(dims))
    near = []
    for shift in product(range(-far, far + 1), repeat=dims):
        gap = sum(max(0, abs(s) - 1) ** 2 for s in shift)
        if gap <= dims:
            near.append(shift)
    return near


def _moved(cell: Column, shift: tuple[int, ...]) -> Column:
    return F.struct(*[(cell[f"g{i}"] + s).alias(f"g{i}") for i, s in enumerate(shift)])


def _apart(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [(p - q) * (p - q) for p, q in zip(a, b)])


def dbscan(df: DataFrame, columns: list[str], id_column: str, eps: float, min_samples: int = 5) -> DataFrame:
    """``id, cluster, core``; noise has cluster -1.

    Clusters are numbered by their smallest core id. A border point joins the
    lowest-numbered cluster within reach.
    """
    dims = len(columns)
    if not 1 <= dims <= MAX_DIMENSIONS:
        raise ParameterError(f"1 to {MAX_DIMENSIONS} columns are supported")
    if eps <= 0 or min_samples < 1:
        raise ParameterError("eps and min_samples must be positive")
    require(df, id_column)
    x = [f"x{i}" for i in range(dims)]
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    points = df.select(quoted(id_column).alias("id"), *[number(df, c).alias(n) for c, n in zip(columns, x)]).na.drop()
    grid = F.struct(*[F.floor(F.col(n) / side).cast("long").alias(f"g{i}") for i, n in enumerate(x)])
    points = materialize(points.withColumn("cell", grid))
    cells = materialize(points.groupBy("cell").agg(F.count("*").alias("n")))
    dense = cells.filter(F.col("n") >= min_samples)

    thin = cells.filter(F.col("n") < min_samples).select(F.col("cell").alias("c"))
    lone = points.join(thin, F.col("cell") == F.col("c"), "left_semi")
    near = F.array(*[_moved(F.col("cell"), s) for s in _reach(dims)])
    around = (
        lone.select("id", "cell", *x)
        .select(F.explode(near).alias("at"), F.struct("id", "cell", *x).alias("p"))
        .groupBy("at")
        .agg(F.collect_list("p").alias("ps"))
    )
    listed = cells.join(around, F.col("cell") == F.col("at")).select("cell", "n", "ps")
    seen = lookup(points, "cell", listed, ["ps"], "n").filter("ps is not null")
    close = F.filter("ps", lambda p: _apart([F.col(n) for n in x], [p[n] for n in x]) <= eps * eps)
    hits = materialize(seen.select("id", "cell", F.explode(close).alias("p")).select("id", "cell", F.col("p.id").alias("lone"), F.col("p.cell").alias("lone_cell")))

    sparse_core = hits.groupBy("lone", "lone_cell").agg(F.count("*").alias("k")).filter(F.col("k") >= min_samples)
    sparse_core = materialize(sparse_core.select(F.col("lone").alias("id"), F.col("lone_cell").alias("cell")))
    dense_cells = dense.select("cell")
    core_cells = materialize(dense_cells.unionByName(sparse_core.select("cell")).distinct())

    to_core = hits.join(sparse_core.select(F.col("id").alias("s")), F.col("lone") == F.col("s"), "left_semi")
    ends = to_core.groupBy("cell", "lone_cell").agg(F.min("id").alias("any"))
    from_dense = ends.join(dense_cells.select(F.col("cell").alias("d")), F.col("cell") == F.col("d"), "left_semi")
    both_lone = to_core.join(sparse_core.select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left_semi")
    edges = from_dense.select("cell", "lone_cell").unionByName(both_lone.select("cell", "lone_cell")).distinct()
    edges = edges.select(F.col("cell").alias("u"), F.col("lone_cell").alias("v")).filter(F.col("u") != F.col("v"))
    edges = materialize(edges.unionByName(_dense_touch(points, dense, x, eps, side, dims)))

    owner = components(core_cells.withColumnRenamed("cell", "node"), edges)
    first = _first_core(points, dense, sparse_core, owner)
    named = running_total(first.withColumn("one", F.lit(1)), "one", ["first"], "cluster").select(
        F.col("root").alias("r"), "cluster"
    )
    cell_cluster = materialize(
        owner.join(named, F.col("root") == F.col("r")).select(F.col("node").alias("cell"), "cluster")
    )
    sized = cell_cluster.join(cells.select(F.col("cell").alias("c"), "n"), F.col("cell") == F.col("c")).drop("c")
    in_dense = lookup(
        points.select("id", "cell"), "cell", sized.join(dense_cells, "cell", "left_semi"), ["cluster"], "n"
    ).filter("cluster is not null").select("id", "cluster", F.lit(True).alias("core"))
    in_lone = sparse_core.join(cell_cluster, "cell").select("id", "cluster", F.lit(True).alias("core"))
    loose = hits.join(sparse_core.select(F.col("id").alias("s")), F.col("lone") == F.col("s"), "left_anti")
    is_core = in_dense.select(F.col("id").alias("k"), F.col("cluster").alias("kc")).unionByName(
        in_lone.select(F.col("id").alias("k"), F.col("cluster").alias("kc"))
    )
    border = (
        loose.join(is_core, F.col("id") == F.col("k"))
        .groupBy(F.col("lone").alias("id"))
        .agg(F.min("kc").alias("cluster"))
        .withColumn("core", F.lit(False))
    )
    found = in_dense.unionByName(in_lone).unionByName(border)
    rest = points.select("id").join(found.select(F.col("id").alias("f")), F.col("id") == F.col("f"), "left_anti")
    return found.unionByName(rest.select("id", F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("core")))


def _first_core(points: DataFrame, dense: DataFrame, sparse_core: DataFrame, owner: DataFrame) -> DataFrame:
    """Smallest core id of every component."""
    least = points.groupBy("cell").agg(F.min("id").alias("first")).join(dense.select("cell"), "cell", "left_semi")
    per_cell = least.unionByName(sparse_core.groupBy("cell").agg(F.min("id").alias("first")))
    joined = per_cell.join(owner, F.col("cell") == F.col("node"))
    return joined.groupBy("root").agg(F.min("first").alias("first"))


def _box_gap(side_a: str, side_b: str, dims: int, farthest: bool) -> Column:
    """Squared least, or greatest, distance between two bounding boxes."""
    total = F.lit(0.0)
    for i in range(dims):
        lo_a, hi_a, lo_b, hi_b = (F.col(f"{s}.{e}{i}") for s in (side_a, side_b) for e in ("lo", "hi"))
        if farthest:
            gap = F.greatest(hi_a - lo_b, hi_b - lo_a)
        else:
            gap = F.greatest(F.lit(0.0), lo_a - hi_b, lo_b - hi_a)
        total = total + gap * gap
    return total


def _dense_touch(points: DataFrame, dense: DataFrame, x: list[str], eps: float, side: float, dims: int) -> DataFrame:
    """Pairs of dense cells with points within ``eps`` of each other.

    A pair is settled once some pair of sub-cell boxes lies wholly within
    reach, or none can; undecided sub-cell pairs go on with half the side.
    """
    half = [s for s in _reach(dims) if s > (0,) * dims]
    a, b = dense.select(F.col("cell").alias("u")), dense.select(F.col("cell").alias("v"))
    open_pairs = materialize(
        a.select("u", F.explode(F.array(*[_moved(F.col("u"), s) for s in half])).alias("v")).join(b, "v", "left_semi")
    )
    touching = open_pairs.limit(0).select("u", "v")
    level = 0
    while open_pairs.take(1):
        wanted = open_pairs.select(F.col("u").alias("cell")).unionByName(open_pairs.select(F.col("v").alias("cell"))).distinct()
        fine = side / (1 << level)
        sub = F.struct(*[F.floor(F.col(n) / fine).cast("long").alias(f"g{i}") for i, n in enumerate(x)])
        bounds = [f(n).alias(f"{e}{i}") for i, n in enumerate(x) for e, f in (("lo", F.min), ("hi", F.max))]
        boxes = points.join(wanted, "cell", "left_semi").groupBy("cell", sub.alias("sub")).agg(*bounds)
        names = [f"{e}{i}" for i in range(dims) for e in ("lo", "hi")]
        boxes = materialize(boxes.select("cell", "sub", F.struct(*names).alias("box")))
        left = boxes.select(F.col("cell").alias("u"), F.col("sub").alias("us"), F.col("box").alias("a"))
        right = boxes.select(F.col("cell").alias("v"), F.col("sub").alias("vs"), F.col("box").alias("b"))
        if level:
            up = lambda s: F.struct(*[F.shiftright(F.col(s)[f"g{i}"], 1).alias(f"g{i}") for i in range(dims)])
            pairs = open_pairs.join(left.withColumn("pu", up("us")), ["u", "pu"]).join(
                right.withColumn("pv", up("vs")), ["v", "pv"]
            )
        else:
            pairs = open_pairs.join(left, "u").join(right, "v")
        judged = pairs.filter(_box_gap("a", "b", dims, False) <= eps * eps).withColumn(
            "sure", _box_gap("a", "b", dims, True) <= eps * eps
        )
        judged = materialize(judged.select("u", "v", F.col("us").alias("pu"), F.col("vs").alias("pv"), "sure"))
        hit = materialize(judged.filter("sure").select("u", "v").distinct())
        touching = touching.unionByName(hit)
        open_pairs = materialize(judged.join(hit, ["u", "v"], "left_anti").select("u", "v", "pu", "pv"))
        level += 1
    return touching


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` with the least node of each connected component.

    Alternating large and small stars; every round is written once. The number
    of rounds grows with the logarithm of the graph, not with its diameter.
    """
    flat = materialize(edges.select("u", "v").distinct())
    before = None
    while True:
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = materialize(large.filter(F.col("u") != F.col("v")).distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))
        flat = materialize(small.distinct())
        h = F.xxhash64("u", "v").cast("decimal(38,0)")
        now = tuple(flat.agg(F.count("*"), F.sum(h)).first())
        if now == before:
            break
        before = now
    joined = nodes.join(flat, F.col("node") == F.col("u"), "left")
    return joined.select("node", F.coalesce("v", "node").alias("root"))
