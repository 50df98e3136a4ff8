"""The transform by tiles against the kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from permafield.functions import tree
from permafield.operators import tiles

RNG = np.random.default_rng(8)


def maps_of(spark, *maps):
    return spark.createDataFrame([(k, e, float(v)) for k, m in enumerate(maps) for e, v in enumerate(m)], "map_id int, element_id long, value float").repartition(6)


def check(spark, grid, cut, connectivity, *maps, **options):
    got = tiles.tfce_tiled(maps_of(spark, *maps), grid, cut, connectivity, **options).orderBy("map_id", "element_id").toPandas()
    n = int(np.prod(grid))
    for k, m in enumerate(maps):
        want = tree.tfce(m.astype(np.float32), tree.Grid(grid, connectivity), options.get("E", 0.5), options.get("H", 2.0), options.get("two_sided", True))
        assert np.allclose(got["enh"].to_numpy()[k * n : (k + 1) * n], want, rtol=2e-5, atol=1e-6), (grid, cut, connectivity)


def smooth(grid):
    v = RNG.normal(size=grid[::-1])
    for axis in range(3):
        v = v + np.roll(v, 1, axis) + np.roll(v, -1, axis)
    return v.ravel()


@pytest.mark.parametrize(
    "grid, cut, connectivity",
    [((7, 6, 5), (7, 6, 5), 26), ((8, 6, 4), (4, 6, 4), 6), ((9, 8, 7), (3, 8, 7), 26), ((9, 8, 7), (5, 4, 4), 18), ((9, 9, 9), (3, 3, 3), 26), ((9, 9, 9), (3, 3, 3), 6), ((6, 5, 1), (1, 1, 1), 26)],
)
def test_tiles_equal_the_kernel(spark, grid, cut, connectivity):
    """Noise, smooth fields, and maps of few levels (equal values everywhere), both signs, cut into 1 to 27 tiles and more."""
    n = int(np.prod(grid))
    check(spark, grid, cut, connectivity, RNG.normal(size=n), smooth(grid), RNG.integers(-3, 4, n).astype(float), np.ones(n))


def test_other_exponents_ranges_and_one_side(spark):
    grid = (8, 7, 6)
    m = smooth(grid)
    check(spark, grid, (4, 4, 3), 26, m, np.where(RNG.random(len(m)) < 0.5, 0.0, m), E=1.0, H=1.0, most=20)  # long branches cut into ranges
    check(spark, grid, (4, 4, 3), 6, m, two_sided=False)
    check(spark, grid, (3, 3, 3), 26, np.round(m), most=3)


def test_empty_and_odd_maps(spark):
    grid = (4, 4, 2)
    odd = np.array([np.nan, np.inf, -np.inf, 0.0] * 8)
    check(spark, grid, (2, 2, 2), 26, np.zeros(32), odd, -np.abs(RNG.normal(size=32)))
    none = maps_of(spark, np.zeros(32)).where("element_id < 0")
    assert tiles.tfce_tiled(none, grid, (2, 2, 2)).count() == 0
    some = maps_of(spark, np.arange(32.0)).where("element_id % 3 = 0")  # absent elements count as 0
    got = tiles.tfce_tiled(some, grid, (2, 4, 1), 6).orderBy("element_id").toPandas()
    full = np.where(np.arange(32) % 3 == 0, np.arange(32.0), 0)
    assert np.allclose(got["enh"], tree.tfce(full, tree.Grid(grid, 6))[::3][: len(got)], rtol=1e-5)
    with pytest.raises(ValueError, match="outside"):
        tiles.tfce_tiled(maps_of(spark, np.ones(40)), grid, (2, 2, 2))


def test_closed_branches_stay_in_their_tile():
    """Only what meets a border leaves a tile: a smooth map's tile gives away far fewer branches than it has."""
    grid = (24, 24, 12)
    m = RNG.normal(size=int(np.prod(grid))).astype(np.float32)
    ids = np.flatnonzero((m > 0) & (np.arange(len(m)) % 24 < 12))
    t = tiles.tile_tree(ids, m[ids], 0, grid, (12, 24, 12), 26)
    assert len(t["closed"]) > 4 * len(t["top_id"]) and len(t["a"]) < len(t["top_id"])
    assert set(t["border_id"] % 24) == {11}
