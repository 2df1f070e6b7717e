"""Regions, hotspots, plates and flips against brute force on small pictures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aislewatch.operators import evidence as E
from aislewatch.operators import regions as G

RUN = "camera_id long, y long, x_start long, x_end long"


def runs_of(mask):
    out = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.r_[0, row.astype(int), 0]))
        out += [(0, y, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def flood(mask, diagonal):
    """Boxes and areas of the components of a picture, a pixel at a time."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (diagonal or dy == 0 or dx == 0) and (dy or dx)]
    while left:
        found, edge = set(), {min(left)}
        while edge:
            found |= edge
            left -= edge
            edge = {(y + dy, x + dx) for y, x in edge for dy, dx in steps} & left
        ys, xs = zip(*found, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(found)))
    return sorted(out)


PICTURES = {
    "u": ["#...#", "#...#", "#####"],
    "n": ["#####", "#...#", "#...#", "#...#"],
    "diagonal": ["##...", "..##.", "....#"],
    "spiral": ["#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########"],
    "comb": ["#.#.#.#", "#.#.#.#", "#######", ".......", "##.#.##"],
}


@pytest.mark.parametrize("name", PICTURES)
@pytest.mark.parametrize(("diagonal", "band"), [(False, 2), (True, 2), (False, 256)])
def test_connected_regions(spark, name, diagonal, band):
    """Bands of two rows put a seam through every shape."""
    mask = np.array([[c == "#" for c in row] for row in PICTURES[name]])
    got = G.connected_regions(spark.createDataFrame(runs_of(mask), RUN), "camera_id", diagonal=diagonal, band=band).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1, r.area) for r in got) == flood(mask, diagonal)


def test_regions_of_a_noisy_picture(spark):
    mask = np.random.default_rng(4).random((60, 60)) < 0.55
    rows = runs_of(mask) + [(0, 3, 5, 5)] + [r for r in runs_of(mask) if r[1] % 7 == 0]  # an empty run, and runs that come twice
    for diagonal in (False, True):
        got = G.connected_regions(spark.createDataFrame(rows, RUN), "camera_id", diagonal=diagonal, band=16, least_area=3).collect()
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.area) for r in got) == [r for r in flood(mask, diagonal) if r[4] >= 3]
    assert G.connected_regions(spark.createDataFrame([], RUN), "camera_id").count() == 0


def test_connected_components_of_long_chains(spark):
    pairs = [(0, i, i + 1) for i in range(200)] + [(1, 5, 5), (1, 9, 3), (1, 3, 1)]
    got = {(r.k, r.node): r.component for r in G.connected_components(spark.createDataFrame(pairs, "k long, a long, b long"), "k").collect()}
    assert got == {**{(0, i): 0 for i in range(201)}, (1, 5): 5, (1, 9): 1, (1, 3): 1, (1, 1): 1}


BOX = "camera_id long, x0 long, y0 long, x1 long, y1 long"


def test_union_area(spark):
    r = np.random.default_rng(2)
    rows = [(c, int(x), int(y), int(x + w), int(y + h)) for c in range(3) for x, y, w, h in r.integers(1, 30, (c * 7 + 1, 4))]
    got = {g.camera_id: g.area for g in G.union_area(spark.createDataFrame(rows, BOX), "camera_id").collect()}
    for c in range(3):
        grid = np.zeros((80, 80), bool)
        for _, x0, y0, x1, y1 in (b for b in rows if b[0] == c):
            grid[y0:y1, x0:x1] = True
        assert got[c] == grid.sum()


def test_hotspots(spark):
    """Cells over half of the frames are strong; two that touch at a corner are one rectangle; the other tier is labelled on its own."""
    boxes = []
    for f in range(10):
        spots = [(100, 100)] * (f < 7) + [(164, 164)] * (f < 6) + [(228, 164)] * (f < 4) + [(1900, 1060)] * (f < 6) + [(600, 600)] * (f < 2)
        boxes += [(0, len(boxes) + i, f, "person", 0.2, x - 10.0, y - 10.0, x + 10.0, y + 10.0) for i, (x, y) in enumerate(spots)]
        boxes.append((0, 1000 + f, f, "person", 0.9, 800.0, 800.0, 900.0, 900.0))
        boxes.append((0, 2000 + f, f, "person", 0.3, 801.0, 801.0, 900.0, 900.0))  # a weaker double, suppressed
    det = spark.createDataFrame(boxes, "camera_id long, det_id long, frame_index long, class_name string, score double, x0 double, y0 double, x1 double, y1 double")
    cells = G.hotspots(det)
    regions = G.hotspot_regions(cells)
    got = sorted((r.tier, r.x0, r.y0, r.x1, r.y1, r.share, r.cells) for r in regions.collect())
    assert got == [("candidate", 160, 96, 288, 224, 0.4, 1), ("strong", 32, 32, 224, 224, 0.7, 2), ("strong", 1824, 992, 1920, 1080, 0.6, 1)]
    cover = G.hotspot_cover(det, regions).first()
    both = np.zeros((1080, 1920), bool)
    for _, x0, y0, x1, y1, _, _ in got:
        both[y0:y1, x0:x1] = True
    assert (cover.regions, cover.area, cover.boxes, cover.covered) == (3, both.sum(), 25, 23)
    assert G.hotspot_cover(det, regions, tiers=("strong",)).first().regions == 2


CELLS = "camera_id long, frame_index long, cell_y long, cell_x long, class_id long"


def test_flip_report(spark):
    """Rates inside and outside the static area, by class, and in the band around a class's region."""
    r = np.random.default_rng(6)
    maps = np.where(np.arange(7)[None, None, :] < 4, 1, 2) * np.ones((12, 6, 7), int)
    noise = r.random(maps.shape) < np.where(np.abs(np.arange(7) - 3.5) < 1, 0.4, 0.05)
    maps = np.where(noise, 3 - maps, maps)
    cells = spark.createDataFrame([(0, f, y, x, int(maps[f, y, x])) for f in range(12) for y in range(6) for x in range(7)], CELLS)
    modal = np.where((maps == 1).sum(axis=0) >= 6, 1, 2)
    static = np.zeros((6, 7), bool)
    static[:, :2] = True
    frame = lambda m: spark.createDataFrame([(0, y, x, int(m[y, x])) for y in range(6) for x in range(7)], "camera_id long, cell_y long, cell_x long, class_id long")
    got = {(g.subject, g.class_id, g.zone): (g.cells, g.pairs, g.flips, g.bounced, g.evaluable) for g in G.flip_report(cells, frame(static).where("class_id = 1"), frame(modal)).collect()}

    def tally(where, of=None):
        out, pairs, n = np.zeros(3, int), 0, 0
        for y, x in zip(*np.nonzero(where), strict=True):
            line = maps[:, y, x]
            at = [t for t in range(1, 12) if of is None or line[t - 1] == of]
            n, pairs = n + bool(at), pairs + len(at)
            for t in at:
                back = line[t - 1] in line[t + 1 : t + 4]
                out += [line[t] != line[t - 1], line[t] != line[t - 1] and back, line[t] != line[t - 1] and (back or t + 3 < 12)]
        return (n, pairs, *map(int, out))

    for zone, where in (("all", np.ones_like(static)), ("static", static), ("moving", ~static)):
        assert got["all", None, zone] == tally(where)
        for c in (1, 2):
            assert got["from", c, zone] == tally(where, c)
    near = lambda y, x: [(y + dy, x + dx) for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]
    of = np.array([[[0 <= a < 6 and 0 <= b < 7 and modal[a, b] == 1 for a, b in near(y, x)] for x in range(7)] for y in range(6)])
    band = of.any(axis=2) & ~of.all(axis=2)
    assert got["band", 1, "all"] == tally(band) and got["interior", 1, "all"] == tally(of.all(axis=2)) and got["band", 1, "moving"] == tally(band & ~static)


def test_plates_and_the_night_veto(spark):
    """The plate is what a share of the slot's frames covers; a slot without one and boxes with too few of its pixels have reasons of their own."""
    r = np.random.default_rng(3)
    masks = r.random((10, 8, 12)) < 0.5
    masks[:, 2:5, 3:9] = True
    rows = [(0, f, "00", y, a, b) for f in range(10) for _, y, a, b in runs_of(masks[f])] + [(0, 0, "00", 3, 4, 8)]
    runs = spark.createDataFrame(rows, "camera_id long, frame_index long, slot string, y long, x_start long, x_end long")
    plate = masks.sum(axis=0) >= 9
    got = G.static_plate(runs, 0.9)
    assert sorted((0, g.y, g.x_start, g.x_end) for g in got.collect()) == sorted(runs_of(plate))
    boxes = [(1, 0, "00", 0.9, False, 30.0, 20.0, 90.0, 50.0), (2, 0, "00", 0.9, False, 0.0, 0.0, 119.0, 79.0), (3, 0, "00", 0.9, False, 31.0, 21.0, 32.0, 22.0), (4, 0, "12", 0.9, False, 30.0, 20.0, 90.0, 50.0), (5, 0, "00", 0.1, False, 30.0, 20.0, 90.0, 50.0), (6, 0, "00", 0.9, True, 30.0, 20.0, 90.0, 50.0), (7, 0, "00", 0.9, False, 500.0, 20.0, 600.0, 50.0)]
    df = spark.createDataFrame(boxes, "det_id long, camera_id long, slot string, score double, excluded boolean, x0 double, y0 double, x1 double, y1 double")
    out = {x.det_id: x for x in E.night_veto(G.plate_shares(df, got, runs, scale=0.1, width=12, height=8, band=3), least_pixels=4).collect()}
    assert {k: x.reason for k, x in out.items()} == {1: "static: furniture", 2: "kept", 3: "kept: plate too coarse", 4: "no static plate", 5: "below score threshold", 6: "camera excluded", 7: "kept: plate too coarse"}
    assert abs(out[2].share - plate.mean()) < 1e-12 and out[1].share == 1.0 and out[3].plate_pixels == 1 and out[4].share is None


def test_whole_runs(spark):
    rows = [(0, 1, 0, 4), (0, 1, 2, 6), (0, 1, 6, 7), (0, 1, 9, 12), (0, 1, 10, 11), (0, 2, 0, 1), (0, 1, 13, 13)]
    got = G.whole_runs(spark.createDataFrame(rows, RUN), "camera_id").orderBy("y", "x_start").select("y", "x_start", "x_end").collect()
    assert [tuple(r) for r in got] == [(1, 0, 7), (1, 9, 12), (2, 0, 1)]
    assert G.static_plate(spark.createDataFrame([], RUN).withColumns({"frame_index": F.lit(1), "slot": F.lit("a")})).count() == 0
