"""Components by tiles, polygons by cover, interpolation by quads, each against a plain version."""

import random

import numpy as np
import pytest

from tidewatch.functions.graphs import least_connected
from tidewatch.operators import regrid


def plain_components(cells, diagonal):
    left, out = set(cells), {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i, j = todo.pop()
            seen.append((i, j))
            for a, b in steps:
                if (i + a, j + b) in left:
                    left.remove((i + a, j + b))
                    todo.append((i + a, j + b))
        i, j = min(seen)
        out |= {c: (f"{i},{j}", len(seen)) for c in seen}
    return out


@pytest.mark.parametrize("seed,tile,step,diagonal", [(1, 3, 2, False), (2, 5, 3, True), (3, 4, 2, False), (4, 64, 16, True)])
def test_components_by_tiles(spark, seed, tile, step, diagonal):
    rng = random.Random(seed)
    cells = {(i, j) for i in range(-9, 22) for j in range(-5, 30) if rng.random() < (0.45 if diagonal else 0.6)}
    df = spark.createDataFrame([*cells, *list(cells)[:5]], "i int, j long")
    found = {(r["i"], r["j"]): (r["component"], r["size"]) for r in regrid.components(df, diagonal, tile=tile, step=step).collect()}
    assert found == plain_components(cells, diagonal)


def test_rounds_do_not_depend_on_the_path(spark, monkeypatch):
    """A snake through every tile takes as many rounds as a straight line of the same extent."""
    rounds = []
    write = regrid.materialize
    monkeypatch.setattr(regrid, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    snake = [(i, j) for i in range(0, 33, 2) for j in range(33)] + [(i, 32 if i % 4 == 1 else 0) for i in range(1, 32, 2)]
    assert {r["size"] for r in regrid.components(spark.createDataFrame(snake, "i int, j int"), tile=4, step=4).collect()} == {len(snake)}
    winding, rounds[:] = rounds.count("joined"), []
    line = [(i, 0) for i in range(33)] + [(0, j) for j in range(33)]
    regrid.components(spark.createDataFrame(line, "i int, j int"), tile=4, step=4).collect()
    assert winding == rounds.count("joined") == 2


def test_no_cells(spark):
    none = spark.createDataFrame([], "i long, j long")
    assert regrid.components(none).collect() == [] and regrid.holes(none, 3, 3).collect() == []


def test_least_connected():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = 60
        a, b = rng.integers(0, n, (2, 40))
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                want[x] = want[y] = min(want[x], want[y])
        assert least_connected(n, a, b).tolist() == want
    path = rng.permutation(5000)
    assert (least_connected(5000, path[:-1], path[1:]) == 0).all()


def edges_of(spark, rings):
    rows = [(z, p, *map(float, a), *map(float, b)) for (z, p), ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return spark.createDataFrame(rows, "zone string, poly_id int, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("levels", [(8.0, 2.0, 0.5), (1.0,), (4.0, 0.25)])
def test_sides_and_corners_belong_to_a_polygon(spark, levels):
    inside = [(0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0), (0.5, 1), (0, 0.3), (1, 0.3), (0.5, 0.5)]
    outside = [(-0.001, 0.5), (1.001, 0.5), (0.5, 1.001), (0.5, -0.001), (2, 1), (-1, 0), (2, 0)]
    points = spark.createDataFrame([(float(y), float(x)) for x, y in inside + outside], "lat double, lon double")
    found = {(r["lon"], r["lat"]): r["zone"] for r in regrid.zone_of_point(points, edges_of(spark, {("unit", 1): [(0, 0), (1, 0), (1, 1), (0, 1)]}), levels=levels).collect()}
    assert found == {p: "unit" for p in inside} | dict.fromkeys(outside)


def holds(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if min(y1, y2) <= y <= max(y1, y2) and min(x1, x2) <= x <= max(x1, x2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
            return True
        if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
            odd = not odd
    return odd


@pytest.mark.parametrize("seed", range(3))
def test_any_polygons(spark, seed):
    """Stars with long thin horns, on points of a fine lattice that also hit corners and sides."""
    rng = random.Random(seed)
    rings = {}
    for p in range(4):
        cx, cy, n = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.randint(3, 14)
        rings["ab"[p % 2], p] = [(round(cx + r * np.cos(t)), round(cy + r * np.sin(t))) for t, r in ((2 * np.pi * k / n, rng.uniform(2, 25)) for k in range(n))]
    points = [(y / 2, x / 2) for y in range(-90, 91, 3) for x in range(-90, 91, 2)]
    df = spark.createDataFrame(points + points[:3], "lat double, lon double")
    found = {}
    for r in regrid.zone_of_point(df, edges_of(spark, rings)).collect():
        found.setdefault((r["lat"], r["lon"]), []).append(r["zone"])
    for k, (y, x) in enumerate(points):
        want = sorted({z for (z, _), ring in rings.items() if holds(ring, x, y)}) or [None]
        assert sorted(found[y, x], key=str) == sorted(want * (2 if k < 3 else 1), key=str), (x, y)


def test_cover_cuts_border_cells_only(spark):
    edges = edges_of(spark, {("box", 1): [(0.1, 0.1), (31.9, 0.1), (31.9, 31.9), (0.1, 31.9)]})
    cover = regrid.polygon_cover(edges, (8.0, 2.0)).collect()
    assert sum(r["inside"] for r in cover if r["level"] == 0) == 4  # 2 x 2 of the large cells are free of edges
    area = sum((64 if r["level"] == 0 else 4) for r in cover)
    assert area == 32 * 32 and sum(not r["inside"] for r in cover) == 60


def test_bilinear_is_one_join(spark, capsys):
    axis_y, axis_x = [0.0, 1.0, 3.0, 7.0], [10.0, 10.5, 12.0]
    source = spark.createDataFrame([(y, x, None if (y, x) == (3.0, 12.0) else 2 * y - 3 * x + x * y) for y in axis_y for x in axis_x], "lat double, lon double, value double")
    targets = [(y / 4, 9.75 + x / 8) for y in range(-2, 32) for x in range(0, 22)]
    target = spark.createDataFrame([(y, x, i) for i, (y, x) in enumerate(targets)], "lat double, lon double, id int")
    out = regrid.bilinear(target, source)
    out.explain()
    plan = capsys.readouterr().out
    joins = [line for line in plan.splitlines() if "Join" in line and "NestedLoop" not in line]  # the loops are with a table of one row
    assert len(joins) == 1
    found = {(r["lat"], r["lon"]): r["value"] for r in out.collect()}
    assert len(found) == len(targets)
    for y, x in targets:
        inside = 0 <= y <= 7 and 10 <= x <= 12
        i, j = min(sum(a <= y for a in axis_y) - 1, 2), min(sum(a <= x for a in axis_x) - 1, 1)
        corners = {(axis_y[i + a], axis_x[j + b]) for a in (0, 1) for b in (0, 1) if inside}
        u, v = (y - axis_y[i]) / (axis_y[i + 1] - axis_y[i]), (x - axis_x[j]) / (axis_x[j + 1] - axis_x[j])
        counts = {(axis_y[i + a], axis_x[j + b]) for a in (0, 1) for b in (0, 1) if (u if a else 1 - u) * (v if b else 1 - v)}
        if not inside or (3.0, 12.0) in counts:
            assert found[y, x] is None, (y, x)
        else:
            assert corners and found[y, x] == pytest.approx(2 * y - 3 * x + x * y), (y, x)


def test_bilinear_on_a_line_and_whole_grids(spark):
    line = spark.createDataFrame([(5.0, x, x) for x in (0.0, 1.0, 2.0)], "lat double, lon double, value double")
    target = spark.createDataFrame([(5.0, 0.25), (5.0, 2.0), (5.1, 1.0)], "lat double, lon double")
    assert {(r["lat"], r["lon"]): r["value"] for r in regrid.bilinear(target, line).collect()} == {(5.0, 0.25): 0.25, (5.0, 2.0): 2.0, (5.1, 1.0): None}
    some = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 1.0, 2.0), (1.0, 0.0, 3.0)], "lat double, lon double, value double")
    whole = regrid.complete_grid(some)
    assert sorted(tuple(r) for r in whole.where("value is null").collect()) == [(1.0, 1.0, None)]
    at = spark.createDataFrame([(0.5, 0.0), (0.5, 0.5)], "lat double, lon double")
    assert {r["lon"]: r["value"] for r in regrid.bilinear(at, whole).collect()} == {0.0: 2.0, 0.5: None}
