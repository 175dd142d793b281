"""Spatial joins on nested grids: polygons are cut into the cells they reach, and points meet them by an equi-join.

Cells of a level are ``STEP`` times wider than those of the level below. Each polygon is cut on the lowest level on which
it spans at most ``SPAN`` cells a side, so its index rows are bounded however much wider than the others it is.

Each index row is one polygon in one cell. A cell wholly inside the polygon needs no test at all; a cell on its
border carries only the edges that can matter there. The join is therefore an ordinary hash join on the cell, and
the exact test runs on few edges. No pair of unrelated rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventrates.functions.columns import is_finite
from eventrates.functions.geometry import contains, crosses_odd, edges_meet, meets_box, ring_edges
from eventrates.session import BROADCAST_LIMIT_BYTES, broadcast_if_small, materialize

LEVEL, CELL_X, CELL_Y, EDGES, WHOLE = "__level", "__cx", "__cy", "__edges", "__whole"
GEOMETRY = ("rings", "minx", "miny", "maxx", "maxy")
SALT, SALTS = "__salt", 32
INDEX_CELLS = 2_000_000
STEP_BITS = 3
STEP, SPAN = 1 << STEP_BITS, 128


def add_bbox(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Add ``minx, miny, maxx, maxy`` from the rings."""
    points = F.flatten(F.col(rings))

    def bound(pick, axis: str) -> Column:
        return pick(F.transform(points, lambda p: p[axis]))

    return polygons.withColumns(
        {
            "minx": bound(F.array_min, "x"),
            "miny": bound(F.array_min, "y"),
            "maxx": bound(F.array_max, "x"),
            "maxy": bound(F.array_max, "y"),
        }
    )


def suggest_cell(polygons: DataFrame, cells: int = INDEX_CELLS) -> float:
    """Cell side that gives the index about ``cells`` rows, from one small aggregate over the polygons.

    Small cells pay: most are then wholly inside a polygon and need no test, and the rest hold few edges. An average
    polygon spans 4 to 32 cells a side.
    """
    boxed = polygons if "minx" in polygons.columns else add_bbox(polygons)
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    count, side = boxed.agg(F.count(extent), F.avg(extent)).first()
    if not side:
        return 1.0
    return side / min(32, max(4, int((cells / count) ** 0.5)))


def _cell_of(coordinate: Column, cell: float, level: Column | int = 0) -> Column:
    return F.floor(coordinate / F.lit(cell)) if isinstance(level, int) and level == 0 else _above(_cell_of(coordinate, cell), level)


def _above(index: Column, levels: Column | int) -> Column:
    """Index of the cell ``levels`` levels above that holds the cell of ``index``."""
    bits = F.lit(levels) * STEP_BITS
    return F.call_function("shiftright", index, bits.cast("int"))


def _side(cell: float, level: Column) -> Column:
    """Side of the cells of a level."""
    return F.pow(F.lit(float(STEP)), level) * F.lit(cell)


def _level_for(extent: Column, cell: float) -> Column:
    """Lowest level on which a polygon of this extent spans at most ``SPAN`` cells a side."""
    spans = F.greatest(extent / F.lit(cell * SPAN), F.lit(1.0))
    return F.ceil(F.log(spans) / F.log(F.lit(float(STEP))) - 1e-9).cast("int")


def _reaches(e: Column, axis: str, index: Column, side: Column, rightward: bool = False) -> Column:
    """The edge's extent on an axis overlaps the cell's; ``rightward`` also accepts edges beyond the cell."""
    slack = 1e-9
    low = (index - slack) * side
    high = (index + (1 + slack)) * side
    a, b = e[f"{axis}1"], e[f"{axis}2"]
    above = F.greatest(a, b) >= low
    return above if rightward else above & (F.least(a, b) <= high)


def _meets_cell(e: Column, x: str, y: str, side: Column, slack: float) -> Column:
    """The edge itself, not only its extent, meets the cell of indices ``x`` and ``y``."""
    bounds = [F.col(x) * side, F.col(y) * side, (F.col(x) + 1) * side, (F.col(y) + 1) * side]
    return meets_box(e, *bounds, slack * side)


def _cut(rows: DataFrame, cell: float, kept: list[str], level: Column, y_range: Column, x_range: Column) -> DataFrame:
    """Rows cut into cells of ``level``, first into bands, then along them; cells outside the polygon leave.

    A row that is whole is only spread, its edges being known not to matter.
    """
    side = _side(cell, F.col(LEVEL))
    banded = rows.select(*kept, level.alias(LEVEL), CELL_X, EDGES, WHOLE, F.explode(y_range).alias(CELL_Y))
    banded = banded.withColumn(EDGES, F.filter(EDGES, lambda e: _reaches(e, "y", F.col(CELL_Y), side)))
    cells = banded.select(*kept, LEVEL, CELL_Y, EDGES, WHOLE, F.explode(x_range).alias(CELL_X))
    cells = cells.withColumns(
        {
            EDGES: F.filter(EDGES, lambda e: _reaches(e, "x", F.col(CELL_X), side, rightward=True)),
            WHOLE: F.col(WHOLE) | ~F.exists(EDGES, lambda e: _meets_cell(e, CELL_X, CELL_Y, side, 1e-9)),
        }
    )
    center_x, center_y = (F.col(CELL_X) + 0.5) * side, (F.col(CELL_Y) + 0.5) * side
    reached = cells.where(F.col(EDGES).isNull() | ~F.col(WHOLE) | crosses_odd(F.col(EDGES), center_x, center_y))
    return reached.withColumn(EDGES, F.when(~F.col(WHOLE), F.col(EDGES)))


def polygon_cells(polygons: DataFrame, cell: float) -> DataFrame:
    """Grid index of polygons: their attributes plus level, cell, local edges, and whether the cell is wholly inside.

    A cell belongs to a polygon when one of its edges meets the cell or the polygon covers it. Each polygon is first cut
    into cells of the level above its own, so that most of its cells look at few of its edges.
    """
    boxed = polygons if "minx" in polygons.columns else add_bbox(polygons)
    attributes = [c for c in polygons.columns if c not in GEOMETRY]
    extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
    own = "__own"
    bounds = {f"__{c}": _cell_of(F.col(c), cell) for c in GEOMETRY[1:]}
    kept = [*attributes, own, *bounds]
    rows = boxed.select(
        *attributes,
        _level_for(extent, cell).alias(own),
        *[index.alias(name) for name, index in bounds.items()],
        F.lit(None).cast("bigint").alias(CELL_X),
        F.lit(None).cast("bigint").alias(CELL_Y),
        ring_edges(F.col("rings")).alias(EDGES),
        F.lit(False).alias(WHOLE),
    ).where(F.col(own).isNotNull())

    def outer(axis: str) -> Column:
        return F.sequence(*[_above(F.col(f"__{end}{axis}"), F.col(own) + 1) for end in ("min", "max")])

    def within(axis: str, index: str) -> Column:
        first = F.col(index) * STEP
        low = F.greatest(first, _above(F.col(f"__min{axis}"), F.col(own)))
        return F.sequence(low, F.greatest(low, F.least(first + (STEP - 1), _above(F.col(f"__max{axis}"), F.col(own)))))

    coarse = _cut(rows, cell, kept, F.col(own) + 1, outer("y"), outer("x"))
    # Coarse cells, with the edges of theirs only, are spread over all cores by count.
    cores = polygons.sparkSession.sparkContext.defaultParallelism
    coarse = coarse.repartition(cores, CELL_Y, CELL_X, *bounds)
    fine = _cut(coarse, cell, kept, F.col(own), within("y", CELL_Y), within("x", CELL_X))
    return fine.select(*attributes, LEVEL, CELL_X, CELL_Y, EDGES, WHOLE)


def _levels(index: DataFrame) -> list[int]:
    """Levels of an index: one more for each eightfold extent, so a handful."""
    return sorted(r[0] for r in index.select(LEVEL).distinct().collect())


def _row_bytes(index: DataFrame, edges: str) -> Column:
    """Size of an index row: its edges, and its other columns as text."""
    others = [c for c in index.columns if c != edges]
    return F.coalesce(F.size(edges), F.lit(0)) * 40 + F.length(F.to_json(F.struct(*others))) + 64


def _salted(many: DataFrame, few: DataFrame, name: str) -> tuple[DataFrame, DataFrame, Column]:
    """Spread a crowded cell: rows of ``many`` draw a salt by their place, each row of ``few`` is there for all."""
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))
    few = few.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn(name, drawn), few, F.col(name) == F.col(SALT)


def points_in(
    points: DataFrame,
    polygons: DataFrame,
    x: str,
    y: str,
    how: str = "inner",
    keys: Sequence[str] = (),
    cell: float | None = None,
    eps: float = 0.0,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Join points to the polygons that contain them (closed: a point on a shared edge matches both).

    ``how="inner"`` adds the polygon attributes, ``"semi"`` only keeps the points inside some polygon. ``keys`` are
    further equality columns such as the year. The index is broadcast when its measured size allows; otherwise both
    sides are shuffled by cell, with a hash salt so that no crowded cell lands in one task. Where polygons of very
    different extents make several levels, a point is looked up on each.
    """
    if how not in ("inner", "semi"):
        raise ValueError(f"unknown join type: {how}")
    cell = cell or suggest_cell(polygons)
    if how == "semi":
        polygons = polygons.select(*keys, *[c for c in GEOMETRY if c in polygons.columns])
    clash = (set(points.columns) & set(polygons.columns)) - set(keys)
    if clash:
        raise ValueError(f"points and polygons share columns {sorted(clash)}; rename them or list them as keys")
    # The index is stored, since it is read for its size and again for the join.
    index = materialize(polygon_cells(polygons, cell))
    located = points.withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
    # A point without two finite coordinates is in no cell.
    finite = is_finite("__x") & is_finite("__y")
    levels = _levels(index)
    index, small = broadcast_if_small(index, _row_bytes(index, EDGES), broadcast_limit)
    renamed = {k: f"__key_{k}" for k in keys}
    index = index.withColumnsRenamed(renamed)
    helpers = ["__x", "__y", "__pl", "__px", "__py", "__point_salt", LEVEL, CELL_X, CELL_Y, EDGES, WHOLE, SALT, *renamed.values()]

    def joined(rows: DataFrame, level: Column, join: str) -> DataFrame:
        rows = rows.withColumn("__pl", level).withColumns(
            {
                "__px": F.when(finite, _cell_of(F.col("__x"), cell, F.col("__pl"))),
                "__py": F.when(finite, _cell_of(F.col("__y"), cell, F.col("__pl"))),
            }
        )
        few = index
        on = [F.col("__pl") == F.col(LEVEL), F.col("__px") == F.col(CELL_X), F.col("__py") == F.col(CELL_Y)]
        on += [F.col(k) == F.col(new) for k, new in renamed.items()]
        if not small:
            rows, few, same = _salted(rows, few, "__point_salt")
            on.append(same)
        on.append(F.col(WHOLE) | contains(F.col(EDGES), F.col("__x"), F.col("__y"), eps))
        return rows.join(few, reduce(lambda a, b: a & b, on), join)

    if how == "inner":
        level = F.explode(F.array(*[F.lit(n) for n in levels])) if len(levels) > 1 else F.lit(levels[0] if levels else 0)
        return joined(located, level, "inner").drop(*helpers)
    # A point is kept once: each level takes those that no level before it has taken.
    found, rest = [], located
    for n in levels or [0]:
        found.append(joined(rest, F.lit(n), "left_semi").drop(*helpers))
        rest = joined(rest, F.lit(n), "left_anti").drop("__pl", "__px", "__py", "__point_salt")
    return reduce(DataFrame.unionAll, found)


def polygons_touching(
    polygons: DataFrame,
    others: DataFrame,
    keys: Sequence[str] = ("YEAR", "GEOID"),
    cell: float | None = None,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Keep polygons that share at least a point with some polygon of ``others`` (touching and containing count).

    ``keys`` identify a polygon.

    Two polygons meet exactly when an edge of one meets an edge of the other, or a corner of one lies in the other.
    Every such witness lies in two cells, one of each, that are equal or one within the other, so the test is made on
    the edges that meet the smaller cell. A polygon that covers a cell meets whatever else is in it. The smaller cell
    finds the wider one by its own cell on that level. Without a broadcast, cells are salted.
    """
    cell = cell or suggest_cell(polygons)
    theirs = {LEVEL: "__ol", CELL_X: "__ox", CELL_Y: "__oy", EDGES: "__oe", WHOLE: "__ow"}
    left = materialize(polygon_cells(polygons, cell).select(*keys, *theirs))
    right = materialize(polygon_cells(others, cell).select(*theirs))
    left_levels, right_levels = _levels(left), _levels(right)
    right = right.withColumnsRenamed(theirs)
    right, small = broadcast_if_small(right, _row_bytes(right, "__oe"), broadcast_limit)
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    mine, other = F.coalesce(F.col(EDGES), none), F.coalesce(F.col("__oe"), none)

    def lifted(rows: DataFrame, level: str, x: str, y: str, to: list[int]) -> DataFrame:
        """Each row once for each of the levels, with its cell there."""
        up = rows.withColumn("__at", F.explode(F.array(*[F.lit(n) for n in to]).cast("array<int>"))).where(F.col("__at") >= F.col(level))
        by = F.col("__at") - F.col(level)
        return up.withColumns({"__ax": _above(F.col(x), by), "__ay": _above(F.col(y), by)})

    def meeting(a: DataFrame, b: DataFrame, wide: tuple[str, str, str], fine: tuple[str, str, str]) -> DataFrame:
        level, x, y = fine
        side = _side(cell, F.col(level))

        def local(edges: Column) -> Column:
            return F.filter(edges, lambda e: _meets_cell(e, x, y, side, 0.0))

        def corner_inside(corners: Column, edges: Column) -> Column:
            here = F.filter(
                corners,
                lambda e: (_cell_of(e["x1"], cell, F.col(level)) == F.col(x)) & (_cell_of(e["y1"], cell, F.col(level)) == F.col(y)),
            )
            return F.exists(here, lambda e: contains(edges, e["x1"], e["y1"]))

        meet = (
            (F.col(WHOLE) & F.col("__ow"))
            | (F.col(WHOLE) & (F.size(local(other)) > 0))
            | (F.col("__ow") & (F.size(local(mine)) > 0))
            | F.exists(local(mine), lambda p: F.exists(local(other), lambda q: edges_meet(p, q)))
            | corner_inside(mine, other)
            | corner_inside(other, mine)
        )
        on = reduce(lambda p, q: p & q, [F.col(n) == F.col(w) for n, w in zip(("__at", "__ax", "__ay"), wide)])
        if not small:
            a, b, same = _salted(a, b, "__own_salt")
            on = on & same
        return a.join(b, on & meet, "left_semi").select(*keys)

    own_cell, their_cell = (LEVEL, CELL_X, CELL_Y), ("__ol", "__ox", "__oy")
    hit = meeting(lifted(left, *own_cell, right_levels), right, their_cell, own_cell)
    if left_levels and right_levels and right_levels[0] < left_levels[-1]:
        above = lifted(right, *their_cell, left_levels).where(F.col("__at") > F.col("__ol"))
        hit = hit.unionAll(meeting(left, above, own_cell, their_cell))
    return polygons.join(hit.distinct(), list(keys), "left_semi").select(*polygons.columns)


def gather_points(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "points") -> DataFrame:
    """Count of the points of each group and their distinct positions, each with its multiplicity.

    The long form of a per-group point union: one row per group and position, so that no group is held whole.
    """
    return df.groupBy(*keys, F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias(out)).agg(
        F.count(F.lit(1)).alias("n")
    )
