"""Components by tiles, morphology on runs, exact distances and nearest boxes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.operators import distance, nearest, raster, runs, spatial, tiles


def _mask(spark, points):
    return spark.createDataFrame(sorted((i, r, c) for i, r, c in points), "image string, row int, col int")


def _set(df):
    return {(r.image, r.row, r.col) for r in df.select("image", "row", "col").collect()}


def _noise(seed, h, w, share, image="a"):
    rng = random.Random(seed)
    return {(image, r, c) for r in range(h) for c in range(w) if rng.random() < share}


def _flood(points, corners):
    left, out = set(points), []
    while left:
        todo = [left.pop()]
        found = set(todo)
        while todo:
            i, r, c = todo.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    p = (i, r + dr, c + dc)
                    if (corners or not (dr and dc)) and p in left:
                        left.discard(p)
                        found.add(p)
                        todo.append(p)
        out.append(frozenset(found))
    return set(out)


def _snake(n):
    """One path that goes to and fro over n x n positions."""
    out = set()
    for r in range(0, n, 2):
        out |= {("s", r, c) for c in range(n)}
        if r + 1 < n:
            out.add(("s", r + 1, 0 if (r // 2) % 2 else n - 1))
    return out


@pytest.mark.parametrize("corners", [False, True])
@pytest.mark.parametrize("side", [1, 4, 512])
def test_components_equal_flood_fill(spark, side, corners):
    points = _noise(1, 21, 19, 0.45) | _noise(2, 12, 30, 0.6, "b") | _snake(17) | {("d", k, k) for k in range(9)} | {("e", -3, -4), ("e", -2, -4), ("e", -1, -5)}
    got = tiles.components(_mask(spark, points).union(_mask(spark, list(points)[:3])), 8 if corners else 4, side).collect()
    parts = {}
    for r in got:
        parts.setdefault((r.image, r.label), set()).add((r.image, r.row, r.col))
    assert {frozenset(p) for p in parts.values()} == _flood(points, corners)
    assert len(got) == len(points)


def test_labels_do_not_depend_on_tiles(spark):
    df = _mask(spark, _snake(23) | _noise(3, 25, 25, 0.5))
    assert sorted(tiles.components(df, 8, 5).collect()) == sorted(tiles.components(df, 8, 64).collect())


def test_runs_of_an_empty_mask_and_null_images(spark):
    df = spark.createDataFrame([(None, 0, 0), (None, 0, 1), (None, 5, 5)], "image string, row int, col int")
    assert raster.components(df).groupBy("image", "label").count().count() == 2
    empty = df.limit(0)
    assert raster.components(empty).count() == raster.dilate(empty, 2).count() == raster.erode(empty, 2).count() == 0
    edge = runs.bounds(df)
    assert _set(raster.closing(df, 1, edge)) >= _set(df)


def _offsets(radius):
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


def _dilated(points, radius, box=None):
    out = {(i, r + a, c + b) for i, r, c in points for a, b in _offsets(radius)}
    return out if box is None else {p for p in out if box[0] <= p[1] <= box[1] and box[2] <= p[2] <= box[3]}


def _eroded(points, radius, box=None):
    inside = lambda r, c: box is None or (box[0] <= r <= box[1] and box[2] <= c <= box[3])
    start = points if box is None else {("a", r, c) for r in range(box[0], box[1] + 1) for c in range(box[2], box[3] + 1)}
    return {(i, r, c) for i, r, c in start if all((i, r + a, c + b) in points for a, b in _offsets(radius) if inside(r + a, c + b))}


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
@pytest.mark.parametrize("bounded", [False, True])
def test_morphology_equals_the_disk(spark, radius, bounded):
    points = _noise(7, 14, 17, 0.8) | {("a", 0, c) for c in range(17)} | {("a", r, 16) for r in range(5, 14)}
    box = (0, 13, 0, 16) if bounded else None
    edge = spark.createDataFrame([("a", 0, 13, 0, 16)], "image string, r0 int, r1 int, c0 int, c1 int") if bounded else None
    found = runs.runs(_mask(spark, points))
    assert _set(runs.pixels(runs.dilate(found, radius, edge))) == _dilated(points, radius, box)
    assert _set(runs.pixels(runs.erode(found, radius, edge))) == _eroded(points, radius, box)
    assert _set(runs.pixels(runs.opening(found, radius, edge))) == _dilated(_eroded(points, radius, box), radius, box)
    assert _set(runs.pixels(runs.closing(found, radius, edge))) == _eroded(_dilated(points, radius, box), radius, box)


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_rasters_that_are_no_rectangle(spark, radius):
    """A last row that ends early and gaps inside are beyond the border."""
    holds = {("a", r, c) for r in range(9) for c in range(12) if (r, c) < (8, 5)} - _noise(5, 9, 12, 0.1)
    points = _noise(8, 9, 12, 0.5) & holds
    edge = runs.runs(_mask(spark, holds))
    grown = lambda p: _dilated(p, radius) & holds
    shrunk = lambda p: (p & holds) - _dilated(holds - p, radius)
    found = runs.runs(_mask(spark, points))
    assert _set(runs.pixels(runs.dilate(found, radius, edge))) == grown(points)
    assert _set(runs.pixels(runs.erode(found, radius, edge))) == shrunk(points)
    assert _set(raster.opening(_mask(spark, points), radius, edge)) == grown(shrunk(points))
    assert _set(raster.closing(_mask(spark, points), radius, edge)) == shrunk(grown(points)) >= points


@pytest.mark.parametrize("operation", ["opening", "closing"])
def test_post_processing_asks_only_pixels_that_there_are(spark, operation):
    """Of a last row that ends early, and of gaps, nothing is asked; an uncertain or invalid pixel is background."""
    holds = {("a", r, c) for r in range(6) for c in range(9) if (r, c) < (5, 4)} - {("a", 2, 7)}
    target = holds - _noise(6, 6, 9, 0.1)
    uncertain, invalid = {("a", 1, 1), ("a", 4, 7)}, {("a", 5, 0)}
    grown = lambda p: _dilated(p, 1) & holds
    shrunk = lambda p: (p & holds) - _dilated(holds - p, 1)
    free = target - uncertain - invalid
    want = (grown(shrunk(free)) if operation == "opening" else shrunk(grown(free))) - uncertain - invalid
    masks = [_mask(spark, p) for p in (target, uncertain, holds - invalid)]
    assert _set(spatial.post_process(*masks, operation=operation, pixels=_mask(spark, holds))) == want
    assert _set(spatial.post_process(*masks, operation=operation)) != want  # the box of the valid pixels


def test_runs_stay_apart(spark):
    found = runs.closing(runs.runs(_mask(spark, _noise(9, 12, 40, 0.6))), 1)
    got = sorted(tuple(r) for r in found.collect())
    assert all(not (a[1] == b[1] and b[2] <= a[3] + 1) for a, b in zip(got, got[1:], strict=False))


def _brute_distance(points):
    rows, cols = [p[1] for p in points], [p[2] for p in points]
    out = [(r, c) for r in range(min(rows), max(rows) + 1) for c in range(min(cols), max(cols) + 1) if ("a", r, c) not in points]
    return {p: min((math.hypot(p[1] - r, p[2] - c) for r, c in out), default=None) for p in points}


@pytest.mark.parametrize("cells", [distance.CELLS, 40])
def test_distance_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(distance, "CELLS", cells)
    disk = {("a", r, c) for r in range(25) for c in range(25) if (r - 12) ** 2 + (c - 12) ** 2 <= 140}
    ring = {p for p in disk if (p[1] - 9) ** 2 + (p[2] - 14) ** 2 > 6}
    cases = {"ring": ring, "disk": disk, "noise": _noise(4, 18, 13, 0.85), "full": {("a", r, c) for r in range(4) for c in range(5)}, "dot": {("a", 3, 3)}, "line": {("a", 0, c) for c in (0, 1, 2, 5)}}
    rows = [(n, i, r, c) for n, points in cases.items() for i, r, c in points]
    df = spark.createDataFrame([*rows, (None, "a", 0, 0)], "item string, image string, row int, col int")
    got = {(r["item"], r["image"], r["row"], r["col"]): r["distance_to_border"] for r in spatial.border_distance(df, "item").collect()}
    for n, points in cases.items():
        for p, want in _brute_distance(points).items():
            assert got[(n, *p)] == (pytest.approx(want) if want is not None else None), (n, p)
    assert got[(None, "a", 0, 0)] is None and len(got) == len(rows) + 1
    near = {(r["item"], r["row"], r["col"]): r["distance_to_border"] for r in spatial.border_distance(df, "item", 2).collect()}
    assert all(near[n, r, c] == (v if v is not None and v <= 2 else None) for (n, _, r, c), v in got.items() if n)


def test_envelope_equals_all_pairs():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 40, 60)
    f = np.full((60, 40), np.inf)
    for i, n in enumerate(size):
        f[i, :n] = rng.choice([0, 1, 4, 9, 100, np.inf], n)
    got = distance.envelope(f, size)
    for i, n in enumerate(size):
        want = [min((q - p) ** 2 + f[i, p] for p in range(n)) for q in range(n)]
        assert got[i, :n].tolist() == want


def _box_rows(rng, n, spread, most):
    out = []
    for k in range(n):
        r, c = rng.randrange(spread), rng.randrange(spread)
        out.append(("a", k, r, r + rng.randrange(most), c, c + rng.randrange(most)))
    return out


BOX = "image string, key int, min_row int, max_row int, min_col int, max_col int"


@pytest.mark.parametrize(("n", "spread", "most"), [(60, 1000, 4), (60, 40, 30), (2, 100_000, 2), (40, 3, 1)])
def test_nearest_box_equals_all_pairs(spark, n, spread, most):
    rows = _box_rows(random.Random(n + spread), n, spread, most)
    rows += [("one", 7, 0, 5, 0, 5), (None, 1, 0, 0, 0, 0), (None, 2, 3, 4, 4, 9), ("lost", 1, None, 2, 0, 1)]
    got = {(r.image, r.key): r for r in nearest.nearest(spark.createDataFrame(rows, BOX), "image", "key").collect()}
    assert len(got) == len(rows) and got["lost", 1].nearest is None
    for i, k, a0, a1, b0, b1 in rows:
        if i == "lost":
            continue
        gaps = {j: math.hypot(max(0, a0 - d1, c0 - a1), max(0, b0 - f1, e0 - b1)) for i2, j, c0, d1, e0, f1 in rows if i2 == i and j != k}
        r = got[i, k]
        assert r.nearest == pytest.approx(min(gaps.values(), default=math.inf))
        assert (r.nearest_key is None) == (not gaps) and (not gaps or gaps[r.nearest_key] == pytest.approx(r.nearest))


def test_hundred_thousand_boxes_in_one_image(spark):
    rng = np.random.default_rng(2)
    side = 316
    at = np.stack(np.meshgrid(np.arange(side), np.arange(side)), -1).reshape(-1, 2) * 20 + rng.integers(0, 6, (side * side, 2))
    import pandas as pd

    pdf = pd.DataFrame({"image": "a", "key": np.arange(len(at)), "min_row": at[:, 0], "max_row": at[:, 0] + 7, "min_col": at[:, 1], "max_col": at[:, 1] + 5})
    far = pd.DataFrame([["a", len(at), 10**7, 10**7 + 1, 0, 1]], columns=pdf.columns)
    copies = pd.DataFrame([["a", len(at) + 1 + k, 50, 60, -900, -890] for k in range(3000)], columns=pdf.columns)
    df = spark.createDataFrame(pd.concat([pdf, far, copies]))
    got = nearest.nearest(df, "image", "key").toPandas().set_index("key")["nearest"]
    assert len(got) == len(at) + 3001 and (got.loc[len(at) + 1 :] == 0).all()
    for k in rng.integers(0, len(at), 40):
        r = np.maximum.reduce([at[k, 0] - at[:, 0] - 7, at[:, 0] - at[k, 0] - 7, 0 * at[:, 0]])
        c = np.maximum.reduce([at[k, 1] - at[:, 1] - 5, at[:, 1] - at[k, 1] - 5, 0 * at[:, 1]])
        d = np.hypot(r, c)
        d[k] = np.inf
        assert got.loc[k] == pytest.approx(d.min())
