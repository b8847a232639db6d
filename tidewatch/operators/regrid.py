"""Group C: alignment, masks, regridding and zones. Axis tables hold the distinct coordinates of one axis and are small."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graphs import least_connected
from ..sources.storage import materialize


def align(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows on the coordinates of both."""
    return a.join(b, key)


def merge_maps(maps: list[DataFrame], key: list[str]) -> DataFrame:
    """Maps side by side on all their coordinates; each keeps its columns."""
    return reduce(lambda a, b: a.join(b, key, "full"), maps)


def attach(target: DataFrame, predictors: DataFrame, key: list[str]) -> DataFrame:
    """Predictors to the target's rows."""
    return target.join(predictors, key, "left")


def land_mask(df: DataFrame, mask: DataFrame, key: list[str], value: str, at_least: float = 0.7, lsm: str = "lsm") -> DataFrame:
    """C4: the value on land, NULL elsewhere, rows kept."""
    return df.join(mask.select(*key, lsm), key, "left").withColumn(value, F.when(F.col(lsm) > at_least, F.col(value))).drop(lsm)


def on_land(df: DataFrame, mask: DataFrame, key: list[str], at_least: float = 0.7, lsm: str = "lsm") -> DataFrame:
    """C4: rows on land only."""
    return df.join(mask.where(F.col(lsm) > at_least).select(*key), key, "left_semi")


def soft_land(lsm: Column) -> Column:
    """Land, or unknown."""
    return (lsm > 0.5) | lsm.isNull()


def snap(x: Column, x0: float, step: float, n: int) -> Column:
    """Place of the nearest point of a regular axis of n points; NULL outside its ends."""
    at = F.floor((x - x0) / step + 0.5).cast("int")
    return F.when((x >= x0) & (x <= x0 + (n - 1) * step), at)


def within(df: DataFrame, ranges: DataFrame, at: str, low: str, high: str, closed: Column | None = None) -> DataFrame:
    """`df` with the columns of the range that holds `at`, from `low` up to and without `high`, or NULL: an equality join on bands.

    Bands are as wide as a range is on average, so that disjoint ranges enter twice as many bands as there are ranges at
    most, and a row meets the ranges of its band only. `closed` marks ranges that consist of `low` alone.
    """
    top = F.coalesce(F.col(high), F.col(low))
    width = ranges.agg(F.coalesce(F.nullif((F.max(top) - F.min(low)).cast("double") / F.count(F.lit(1)), F.lit(0.0)), F.lit(1.0)).alias("_width"))
    width = F.broadcast(width)  # one row
    band = lambda x: F.floor(x / F.col("_width"))
    banded = ranges.join(width).withColumn("_band", F.explode(F.sequence(band(F.col(low)), band(top)))).drop("_width")
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    inside = inside if closed is None else inside | closed & (F.col(at) == F.col(low))
    left = df.join(width).withColumn("_at_band", band(F.col(at))).drop("_width")
    return left.join(banded, (F.col("_at_band") == F.col("_band")) & inside, "left").drop("_band", "_at_band")


def brackets(axis: DataFrame, x: str = "x") -> DataFrame:
    """An axis as intervals (x0, x1) between neighbours; the last point is an interval of its own."""
    w = Window.orderBy(x)  # the distinct points of one axis
    return axis.select(F.col(x).alias("x0"), F.lead(x).over(w).alias("x1"))


def nearest_on_axis(target: DataFrame, axis: DataFrame, at: str, out: str) -> DataFrame:
    """Nearest point of an irregular axis (the lower of two as near); NULL outside."""
    near = F.when(F.col("x1").isNull() | (F.col(at) - F.col("x0") <= F.col("x1") - F.col(at)), F.col("x0")).otherwise(F.col("x1"))
    return within(target, brackets(axis), at, "x0", "x1", F.col("x1").isNull()).withColumn(out, near).drop("x0", "x1")


def complete_grid(source: DataFrame, value: str = "value") -> DataFrame:
    """A row for each latitude and longitude of `source`, NULL where it had none; axes are broadcast to each other by Spark if small."""
    return source.select("lat").distinct().crossJoin(source.select("lon").distinct()).join(source.select("lat", "lon", value), ["lat", "lon"], "left")


def quads(source: DataFrame, value: str = "value") -> DataFrame:
    """Each cell of a map with its three neighbours to the north and east: lat0, lat1, lon0, lon1, v00, v01, v10, v11, and whether it
    is the last on its axes (`_top`, `_right`), whose far sides belong to it.

    Neighbours come from two windows, along the rows and along the columns. Of an axis of one point, that point is its own neighbour.
    """
    row, column = Window.partitionBy("lat").orderBy("lon"), Window.partitionBy("lon").orderBy("lat")
    alone = lambda axis, w: F.when(F.lag(axis).over(w).isNull(), F.col(axis))
    s = source.select("lat", "lon", F.col(value).alias("v00"))
    s = s.withColumns({"lon1": F.coalesce(F.lead("lon").over(row), alone("lon", row)), "v01": F.coalesce(F.lead("v00").over(row), F.when(F.lead("lon").over(row).isNull(), F.col("v00"))), "_right": F.lead("lon", 2).over(row).isNull()})
    above = F.lead("lat").over(column)
    s = s.withColumns({
        "lat1": F.coalesce(above, alone("lat", column)), "v10": F.when(above.isNull(), F.col("v00")).otherwise(F.lead("v00").over(column)), "v11": F.when(above.isNull(), F.col("v01")).otherwise(F.lead("v01").over(column)),
        "_same": above.isNull() | F.lead("lon1").over(column).eqNullSafe(F.col("lon1")), "_top": F.lead("lat", 2).over(column).isNull(),
    })
    return s.where("_same and lat1 is not null and lon1 is not null").select(F.col("lat").alias("lat0"), "lat1", F.col("lon").alias("lon0"), "lon1", "v00", "v01", "v10", "v11", "_top", "_right")


def bilinear(target: DataFrame, source: DataFrame, value: str = "value") -> DataFrame:
    """`target` (lat, lon) with the source map's value between its four cells; NULL outside or where a cell that counts is missing.

    `source` has a row for each pair of its axes, as maps do (`complete_grid` makes them). Its cells carry their neighbours, so
    that one equality join on bands of latitude and longitude finds all four; bands are as wide as a cell would be if cells were square.
    """
    size = source.agg(*(F.coalesce(F.nullif((F.max(c) - F.min(c)) / F.sqrt(F.count(F.lit(1))), F.lit(0.0)), F.lit(1.0)).alias(f"_w{c}") for c in ("lat", "lon")))
    size = F.broadcast(size)  # one row
    band = lambda x, c: F.floor(x / F.col(f"_w{c}"))
    spread = lambda c: F.explode(F.sequence(band(F.col(f"{c}0"), c), band(F.col(f"{c}1"), c))).alias(f"_b{c}")
    q = quads(source, value).join(size).select("*", spread("lat")).select("*", spread("lon")).drop("_wlat", "_wlon")
    t = target.join(size).select(target["*"], *(band(F.col(c), c).alias(f"_t{c}") for c in ("lat", "lon")))
    inside = lambda c, last: (F.col(c) >= F.col(f"{c}0")) & ((F.col(c) < F.col(f"{c}1")) | (F.col(last) & (F.col(c) == F.col(f"{c}1"))))
    out = t.join(q, (F.col("_tlat") == F.col("_blat")) & (F.col("_tlon") == F.col("_blon")) & inside("lat", "_top") & inside("lon", "_right"), "left")
    share = lambda c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")), F.lit(0.0))
    y, x = share("lat"), share("lon")
    weights = {"v00": (1 - y) * (1 - x), "v01": (1 - y) * x, "v10": y * (1 - x), "v11": y * x}
    mixed = reduce(lambda a, b: a + b, (F.when(w == 0, F.lit(0.0)).otherwise(w * F.col(v)) for v, w in weights.items()))
    return out.select(*target.columns, F.when(F.col("lat0").isNotNull(), mixed).alias(value))


def common_grid(maps: list[DataFrame], step: float, value: str = "value") -> DataFrame:
    """A grid over all maps at one step, each map interpolated to it, the mean where several overlap."""
    boxes = reduce(lambda a, b: a.unionByName(b), (m.select("lat", "lon") for m in maps)).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("a", F.min), ("b", F.max))))
    axis = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col(f"b_{c}") - F.col(f"a_{c}")) / step + 1e-9).cast("int")), lambda i: F.col(f"a_{c}") + i * step)).alias(c)
    grid = boxes.select(axis("lat"), "a_lon", "b_lon").select("lat", axis("lon"))
    each = [bilinear(grid, complete_grid(m, value), value) for m in maps]
    return reduce(lambda a, b: a.unionByName(b), each).where(F.col(value).isNotNull()).groupBy("lat", "lon").agg(F.avg(value).alias(value))


def coarsen(df: DataFrame, factor: int, key: list[str], value: str = "value") -> DataFrame:
    """Means over factor x factor cells; cells that do not fill a block at the end of an axis drop out."""
    out = df
    for axis in ("lat", "lon"):
        points = df.select(axis).distinct()
        w = Window.orderBy(axis)  # the distinct points of one axis
        numbered = points.select(axis, F.floor((F.row_number().over(w) - 1) / factor).alias("_b"), F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / factor).alias("_n"))
        blocks = numbered.where("_b < _n").select(axis, F.avg(axis).over(Window.partitionBy("_b")).alias(f"_{axis}"))
        out = out.join(blocks, axis)
    return out.groupBy(*key, F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).agg(F.avg(value).alias(value))


def polygon_cover(edges: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Cells that cover polygons: level, row, col, zone, poly_id and `inside` (all of the cell is, borders too) or not (an edge passes through it).

    `levels` are sizes of cells, each a multiple of the next. Only cells that an edge passes through are cut into those of the
    next level, so inside cells are as large as can be, and border cells are of the last level only.
    """
    out, parents = None, None
    for n, g in enumerate(levels):
        band = lambda v, g=g: F.floor(v / g)
        e = edges.withColumn("row", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
        # where the edge enters and leaves the row; a little more, so that rounding puts no point of an edge outside its cells
        clip = lambda v: F.greatest(F.least(v, (F.col("row") + 1) * g), F.col("row") * g)  # noqa: E731, B023
        at = lambda y: F.col("x1") + F.coalesce(F.try_divide((y - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1")), F.lit(0.0))
        level_edge = F.col("y1") == F.col("y2")
        a, b = F.when(level_edge, F.col("x1")).otherwise(at(clip(F.col("y1")))), F.when(level_edge, F.col("x2")).otherwise(at(clip(F.col("y2"))))
        border = e.withColumn("col", F.explode(F.sequence(band(F.least(a, b) - 1e-9 * g), band(F.greatest(a, b) + 1e-9 * g)))).select("zone", "poly_id", "row", "col").distinct()
        middle = (F.col("row") + 0.5) * g
        crosses = (F.least("y1", "y2") <= middle) & (middle < F.greatest("y1", "y2"))
        crossings = e.where(crosses).groupBy("zone", "poly_id", "row").agg(F.sort_array(F.collect_list(at(middle))).alias("_xs"))
        if parents is None:
            # runs of cells between the first and second crossing, the third and fourth, ...
            pair = F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size("_xs") - 1), lambda i: i % 2 == 0), lambda i: F.struct(F.get("_xs", i).alias("a"), F.get("_xs", i + 1).alias("b"))))
            runs = crossings.select("zone", "poly_id", "row", pair.alias("_r"))
            first, last = F.ceil(F.col("_r.a") / g - 0.5), F.floor(F.col("_r.b") / g - 0.5)
            cells = runs.where(first <= last).select("zone", "poly_id", "row", F.explode(F.sequence(first, last)).alias("col"))
        else:
            ratio = round(levels[n - 1] / g)
            children = parents.select("zone", "poly_id", F.explode(F.sequence(F.col("row") * ratio, (F.col("row") + 1) * ratio - 1)).alias("row"), F.col("col").alias("_p"))
            children = children.select("zone", "poly_id", "row", F.explode(F.sequence(F.col("_p") * ratio, (F.col("_p") + 1) * ratio - 1)).alias("col"))
            east = F.size(F.filter("_xs", lambda x: x > (F.col("col") + 0.5) * g))
            cells = children.join(crossings, ["zone", "poly_id", "row"]).where(east % 2 == 1).select("zone", "poly_id", "row", "col")
        inside = cells.join(border, ["zone", "poly_id", "row", "col"], "left_anti").withColumn("inside", F.lit(True))
        found = inside if n < len(levels) - 1 else inside.unionByName(border.withColumn("inside", F.lit(False)))
        found = found.withColumn("level", F.lit(n))
        out = found if out is None else out.unionByName(found)
        parents = border
    return out


def zone_of_point(points: DataFrame, edges: DataFrame, lat: str = "lat", lon: str = "lon", levels: tuple[float, ...] = (8.0, 2.0, 0.5)) -> DataFrame:
    """C11: points with `zone` for each polygon that holds them or has them on an edge or corner; NULL outside all.

    `edges` are zone, poly_id, x1, y1, x2, y2. Points meet the cells that cover the polygons by equality; those in an inside cell are
    done, and only those in a cell that an edge passes through meet the edges of its polygon in their row: they are on one,
    or an odd number lies to the east. Distinct coordinates are tested once.
    """
    places = points.select(F.col(lat).alias("_y"), F.col(lon).alias("_x")).distinct()
    cover = polygon_cover(edges, levels)
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("_y") / g).alias("row"), F.floor(F.col("_x") / g).alias("col")) for n, g in enumerate(levels))))
    met = places.select("_y", "_x", cells.alias("_c")).select("_y", "_x", "_c.*").join(cover, ["level", "row", "col"]).select("_y", "_x", "row", "zone", "poly_id", "inside")
    g = levels[-1]
    banded = edges.withColumn("row", F.explode(F.sequence(F.floor(F.least("y1", "y2") / g), F.floor(F.greatest("y1", "y2") / g))))
    y, x, x1, y1, x2, y2 = (F.col(c) for c in ("_y", "_x", "x1", "y1", "x2", "y2"))
    between = (F.least(y1, y2) <= y) & (y <= F.greatest(y1, y2)) & (F.least(x1, x2) <= x) & (x <= F.greatest(x1, x2))
    on = between & ((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1))
    east = (F.least(y1, y2) <= y) & (y < F.greatest(y1, y2)) & (x1 + F.try_divide((y - y1) * (x2 - x1), y2 - y1) > x)
    near = met.where("not inside").join(banded, ["zone", "poly_id", "row"]).groupBy("_y", "_x", "zone", "poly_id").agg(F.max(on).alias("_on"), F.count_if(east).alias("_n"))
    hits = met.where("inside").select("_y", "_x", "zone").unionByName(near.where("_on or _n % 2 = 1").select("_y", "_x", "zone")).distinct()
    return points.join(hits, (points[lat] == hits["_y"]) & (points[lon] == hits["_x"]), "left").select(points["*"], "zone")


def crop_masks(urban: Column, crop: Column, irrigated: Column, urban_max: float = 3, crop_min: float = 25, irrigated_min: float = 60) -> dict[str, Column]:
    """not_urban (or unknown), cropland, irrigated and rain-fed cropland; missing covers count as none."""
    cropland = F.coalesce(crop > crop_min, F.lit(False))
    wet = F.coalesce(irrigated >= irrigated_min, F.lit(False))
    return {"not_urban": (urban <= urban_max) | urban.isNull(), "cropland": cropland, "irrigated": cropland & wet, "rainfed": cropland & ~wet}


def percent_to_share(df: DataFrame, column: str) -> DataFrame:
    """A cover in per cent (any value above 1.5) divided by 100."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > 1.5, F.col(column) / 100).otherwise(F.col(column))).drop("_top")


def choose_by_mask(positive: Column, negative: Column, pos_value: Column, neg_value: Column, full_value: Column) -> Column:
    """The value of the pass that the cell belongs to."""
    return F.when(F.coalesce(positive, F.lit(False)), pos_value).when(F.coalesce(negative, F.lit(False)), neg_value).otherwise(full_value)


def domain_label(df: DataFrame, key: list[str], positive: Column, inside: Column) -> DataFrame:
    """C14: keys that have any value inside the domain, and whether any is positive."""
    g = df.groupBy(*key).agg(F.max(inside.isNotNull()).alias("_in"), F.max(F.coalesce(positive, F.lit(False))).alias("target"))
    return g.where("_in").drop("_in")


def components(cells: DataFrame, diagonal: bool = False, tile: int = 256, step: int = 16) -> DataFrame:
    """Cells (i, j) with `component` (the least i, j of its cells as a string of the label) and its `size`, joined by shared edges.

    Cells are labelled inside square tiles, each in a task. Then only the labels that touch across the sides of tiles are left, as
    edges of a graph; tiles `step` times as large join those inside them, level by level, until none is left. So the
    number of rounds depends on the extent of the map alone, not on how long or winding a component is.
    """
    shape = "i long, j long, li long, lj long"

    def label(part):
        import pyarrow as pa

        i, j = part.column("i").to_numpy(), part.column("j").to_numpy()
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        width = int(j.max() - j.min()) + 3
        code = (i - i.min()) * width + (j - j.min()) + 1
        a, b = [], []
        for by in (1, width, *((width - 1, width + 1) if diagonal else ())):
            at = np.minimum(np.searchsorted(code, code + by), len(code) - 1)
            found = np.flatnonzero(code[at] == code + by)
            a.append(found)
            b.append(at[found])
        least = least_connected(len(code), np.concatenate(a), np.concatenate(b))
        return pa.table({"i": i, "j": j, "li": i[least], "lj": j[least]})

    cells = cells.select(F.col("i").cast("long"), F.col("j").cast("long")).where("i is not null and j is not null").distinct()
    corner = cells.agg(F.coalesce(F.min("i"), F.lit(0)).alias("i"), F.coalesce(F.min("j"), F.lit(0)).alias("j")).first()  # tiles of all levels begin there
    from_corner = lambda c: F.col(c) - F.lit(corner[c[0]])
    in_tile = lambda c, size: F.floor(from_corner(c) / size)
    at_side = lambda c, *places: F.pmod(from_corner(c), F.lit(tile)).isin(*places)
    labelled = materialize(cells.withColumns({"_ti": in_tile("i", tile), "_tj": in_tile("j", tile)}).groupBy("_ti", "_tj").applyInArrow(label, shape), "cells")
    # pairs of cells that touch across a side: a border cell looks right, down and perhaps aslant
    looks = F.array(*(F.struct(F.lit(p).cast("long").alias("a"), F.lit(q).cast("long").alias("b")) for p, q in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ()))))
    outer = at_side("i", tile - 1) | at_side("j", tile - 1, *((0,) if diagonal else ()))
    reach = labelled.where(outer).select("i", "j", "li", "lj", F.explode(looks).alias("_s")).select("i", "j", "li", "lj", (F.col("i") + F.col("_s.a")).alias("i2"), (F.col("j") + F.col("_s.b")).alias("j2"))
    reach = reach.where((in_tile("i", tile) != in_tile("i2", tile)) | (in_tile("j", tile) != in_tile("j2", tile)))
    other = labelled.where(at_side("i", 0, tile - 1) | at_side("j", 0, tile - 1)).select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("li").alias("mi"), F.col("lj").alias("mj"))
    edges = materialize(reach.join(other, ["i2", "j2"]).select("i", "j", "i2", "j2", "li", "lj", "mi", "mj"), "edges")

    def join(part):
        import pyarrow as pa

        ends = np.stack([np.concatenate((part.column(a).to_numpy(), part.column(b).to_numpy())) for a, b in (("li", "mi"), ("lj", "mj"))], axis=1)
        names, at = np.unique(ends, axis=0, return_inverse=True)
        at = at.reshape(-1)
        n = part.num_rows
        least = least_connected(len(names), at[:n], at[n:])
        return pa.table({"li": names[:, 0], "lj": names[:, 1], "ri": names[least, 0], "rj": names[least, 1]})

    roots, size = None, tile
    while edges.limit(1).count():
        size *= step
        inside = (in_tile("i", size) == in_tile("i2", size)) & (in_tile("j", size) == in_tile("j2", size))
        here = edges.where(inside).withColumns({"_ti": in_tile("i", size), "_tj": in_tile("j", size)})
        joined = materialize(here.groupBy("_ti", "_tj").applyInArrow(join, "li long, lj long, ri long, rj long"), "joined")
        further = joined.select(F.col("li").alias("ri"), F.col("lj").alias("rj"), F.col("ri").alias("_i"), F.col("rj").alias("_j"))
        if roots is None:
            roots = joined
        else:
            moved = roots.join(further, ["ri", "rj"], "left").select("li", "lj", F.coalesce("_i", "ri").alias("ri"), F.coalesce("_j", "rj").alias("rj"))
            roots = materialize(moved.unionByName(joined.join(roots.select("li", "lj"), ["li", "lj"], "left_anti")), "roots")
        left = edges.where(~inside)
        for a, b in (("li", "lj"), ("mi", "mj")):
            names = joined.select(F.col("li").alias(a), F.col("lj").alias(b), "ri", "rj")
            left = left.join(names, [a, b], "left").withColumns({a: F.coalesce("ri", a), b: F.coalesce("rj", b)}).drop("ri", "rj")
        edges = materialize(left, "edges")
    parts = labelled.groupBy("li", "lj").agg(F.count(F.lit(1)).alias("_n"))
    named = parts.withColumns({"ri": F.col("li"), "rj": F.col("lj")}) if roots is None else parts.join(roots, ["li", "lj"], "left").select("li", "lj", "_n", F.coalesce("ri", "li").alias("ri"), F.coalesce("rj", "lj").alias("rj"))
    sizes = named.groupBy("ri", "rj").agg(F.sum("_n").alias("size"))
    of_label = named.join(sizes, ["ri", "rj"]).select("li", "lj", F.concat_ws(",", "ri", "rj").alias("component"), "size")
    return labelled.join(of_label, ["li", "lj"]).select("i", "j", "component", "size")


def holes(cells: DataFrame, rows: int, cols: int, land: DataFrame | None = None) -> DataFrame:
    """Cells of a rows x cols grid that are not in `cells` and whose component does not reach the border; those of `land` (i, j) only, if given."""
    spark = cells.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("i"), (F.col("id") % cols).alias("j"))
    empty = components(grid.join(cells.select("i", "j").distinct(), ["i", "j"], "left_anti"))
    border = empty.where((F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == rows - 1) | (F.col("j") == cols - 1)).select("component").distinct()
    found = empty.join(border, "component", "left_anti").select("i", "j")
    return found if land is None else found.join(land.select("i", "j").distinct(), ["i", "j"], "left_semi")
