"""The exact cluster transform of maps larger than one task: trees of tiles, merged along borders.

A map is cut into boxes. In each tile basins are joined by their saddles from the highest down; a component that has not met the tile's border by
the saddle at which it joins another is *closed*: nothing outside changes it, so it becomes a branch that ends there. What is left
of a tile is its border and the saddles between *open* components. Only that comes together, to join the open components of all tiles
into branches too. So every element belongs to one branch, which grows by its own elements and, where another branch ends in it, by all of
that one's. Sizes and integrals along branches are running sums over distinct levels, taken over ranges where a branch is long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permafield.functions import tree
from permafield.sources.files import scratch

#: Most border elements of one map that a task joins; levels of a branch beyond which it is cut into ranges.
MOST_BORDER, LEVELS = 50_000_000, 1_000_000

TREES = "m long, tile long, ids binary, level binary, branch binary, closed binary, parent binary, ends binary, border_id binary, border_level binary, border_branch binary, a binary, b binary, saddle binary, top_id binary, top binary"
ATTACHED = "m long, k long, branch long, parent long, ends float"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "float": pa.float32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _box(tile: int, grid, tiles) -> tuple[list[int], list[int]]:
    """Where a tile begins and ends on each axis."""
    counts = [-(-g // t) for g, t in zip(grid, tiles)]
    at = [tile % counts[0], tile // counts[0] % counts[1], tile // (counts[0] * counts[1])]
    return [a * t for a, t in zip(at, tiles)], [min(g, (a + 1) * t) for a, t, g in zip(at, tiles, grid)]


class Branches:
    """Where branches end, with jumps of doubling length: which branch holds an element of a level, starting from any of its ancestors."""

    def __init__(self, branch: np.ndarray, parent: np.ndarray, ends: np.ndarray):
        self.ids = np.unique(np.concatenate([branch, parent]))
        up = np.arange(len(self.ids))
        up[np.searchsorted(self.ids, branch)] = np.searchsorted(self.ids, parent)
        self.ends = np.full(len(self.ids), -1.0, np.float32)  # roots end nowhere
        self.ends[np.searchsorted(self.ids, branch)] = ends
        self.lifts, least = [up], [self.ends]
        while (self.lifts[-1] != self.lifts[-1][self.lifts[-1]]).any():
            jump, end = self.lifts[-1], least[-1]
            least.append(np.minimum(end, end[jump]))
            self.lifts.append(jump[jump])
        self.least = least

    def at(self, branch: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The branch that holds ``level``, from branches that hold it or end above it: those that end at or above it are left."""
        if not len(self.ids) or not len(branch):
            return branch
        where = np.minimum(np.searchsorted(self.ids, branch), len(self.ids) - 1)
        known = self.ids[where] == branch
        now = where.copy()
        # A jump is taken where every branch left by it ends at or above the level; ends fall along the way, so the least one tells.
        for lift, least in zip(reversed(self.lifts), reversed(self.least)):
            now = np.where(least[now] >= level, lift[now], now)
        return np.where(known, self.ids[now], branch)


def tile_tree(ids: np.ndarray, values: np.ndarray, tile: int, grid, tiles, connectivity: int) -> dict[str, np.ndarray] | None:
    """The branches of one tile's positive elements: each element's ``branch``, the ``closed`` branches in the order in which they end, the border
    elements, and the ``saddle`` s between open branches ``a`` and ``b``; branches are named by the element of their peak."""
    low, high = _box(tile, grid, tiles)
    shape = [b - a for a, b in zip(low, high)]
    space = tree.Grid(shape, connectivity)
    x, y, z = ids % grid[0], ids // grid[0] % grid[1], ids // (grid[0] * grid[1])
    local = (x - low[0]) + shape[0] * ((y - low[1]) + shape[1] * (z - low[2]))
    full = np.zeros(space.n, np.float32)
    full[local] = values
    found = tree.basins(full, space)
    if found is None:
        return None
    order, _, basin, peaks, one, two, low_rank = found
    n, k, height = len(order), len(peaks), full[order]
    px, py, pz = order % shape[0], order // shape[0] % shape[1], order // (shape[0] * shape[1])
    name = (px + low[0]) + grid[0] * ((py + low[1]) + grid[1] * (pz + low[2]))
    border = np.zeros(n, bool)
    for p, lo, hi, g, size in zip((px, py, pz), low, high, grid, shape):
        border |= (p == 0) & (lo > 0)
        border |= (p == size - 1) & (hi < g)
    # The rank at which a component first meets the border.
    opens = np.full(k, n, np.int64)
    np.minimum.at(opens, basin[border], np.flatnonzero(border))
    opens = opens.tolist()
    root, main = list(range(k)), list(range(k))
    closed, parent, ends, edges = [], [], [], []
    for a, b, at in zip(one.tolist(), two.tolist(), low_rank.tolist()):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        if a == b:
            continue
        if opens[a] <= at and opens[b] <= at:
            edges.append((main[a], main[b], at))
            if main[b] < main[a]:
                a, b = b, a
        else:
            if opens[b] > at and (opens[a] <= at or main[a] < main[b]):
                pass  # b ends in a
            else:
                a, b = b, a
            closed.append(main[b])
            parent.append(main[a])
            ends.append(at)
        root[b] = a
        opens[a] = min(opens[a], opens[b])
    peak_name = name[peaks]
    closed_a, parent_a = peak_name[np.asarray(closed, int)], peak_name[np.asarray(parent, int)]
    ends_a = height[np.asarray(ends, int)]
    branch = Branches(closed_a, parent_a, ends_a).at(peak_name[basin], height)
    gone = set(closed)
    alive = np.array([c for c in range(k) if c not in gone], int)
    e = np.asarray(edges, int).reshape(-1, 3)
    return {
        "ids": name, "level": height, "branch": branch, "closed": closed_a, "parent": parent_a, "ends": ends_a,
        "border_id": name[border], "border_level": height[border], "border_branch": branch[border],
        "a": peak_name[e[:, 0]], "b": peak_name[e[:, 1]], "saddle": height[e[:, 2]], "top_id": peak_name[alive], "top": height[peaks[alive]],
    }


_KINDS = {"level": "<f4", "ends": "<f4", "border_level": "<f4", "saddle": "<f4", "top": "<f4"}


def _read(value, column: str) -> np.ndarray:
    return np.frombuffer(value.as_py(), _KINDS.get(column, "<i8"))


def tile_trees(maps: DataFrame, grid, tiles, connectivity: int) -> DataFrame:
    """TREES of every tile with a positive element, for positive and negative parts: ``m`` is twice the map's number, and one more for the
    negative part. One shuffle, by tile."""
    counts = [-(-g // t) for g, t in zip(grid, tiles)]
    e = F.col("element_id")
    x, y, z = e % grid[0], F.floor(e / grid[0]) % grid[1], F.floor(e / (grid[0] * grid[1]))
    tile = F.floor(x / tiles[0]) + counts[0] * (F.floor(y / tiles[1]) + counts[1] * F.floor(z / tiles[2]))
    v = F.col("value").cast("float")
    rows = maps.select((F.col("map_id").cast("long") * 2 + F.when(v < 0, 1).otherwise(0)).alias("m"), tile.cast("long").alias("tile"), e.cast("long").alias("id"), F.abs(v).alias("v"))
    rows = rows.where("v > 0 and not isnan(v) and v < float('infinity')")
    out = _arrow(TREES)

    def run(key, table):
        found = tile_tree(table.column("id").to_numpy(), table.column("v").to_numpy(), key[1].as_py(), grid, tiles, connectivity)
        row = [key[0].as_py(), key[1].as_py(), *(np.ascontiguousarray(found[f.name], _KINDS.get(f.name, "<i8")).tobytes() for f in list(out)[2:])]
        return pa.Table.from_arrays([pa.array([c], f.type) for c, f in zip(row, out)], schema=out)

    return rows.groupBy("m", "tile").applyInArrow(run, TREES)


def joined_borders(trees: DataFrame, grid, connectivity: int) -> DataFrame:
    """ATTACHED: where the open branches of a map end, in order. A task holds the borders and open saddles of one map, not its elements."""
    most = trees.groupBy("m").agg(F.sum(F.length("border_id") / 8).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_BORDER:
        raise ValueError(f"a map's tiles have {most:.0f} border elements, more than {MOST_BORDER}: use larger tiles")
    out = _arrow(ATTACHED)

    def run(key, table):
        def every(column):
            return np.concatenate([_read(v, column) for v in table.column(column)] or [np.empty(0)])

        tile = np.repeat(table.column("tile").to_numpy(), [len(v.as_py()) // 8 for v in table.column("border_id")])
        ids, level, branch = every("border_id"), every("border_level"), every("border_branch")
        by = np.argsort(ids)
        ids, level, branch, tile = ids[by], level[by], branch[by], tile[by]
        a, b, s = [every("a")], [every("b")], [every("saddle")]
        at = [ids % grid[0], ids // grid[0] % grid[1], ids // (grid[0] * grid[1])]
        for step in tree.half_offsets(connectivity):
            inside = np.ones(len(ids), bool)
            for p, d, g in zip(at, step, grid):
                inside &= (p + d >= 0) & (p + d < g)
            other = ids + step[0] + grid[0] * (step[1] + grid[1] * step[2])
            where = np.minimum(np.searchsorted(ids, other), max(0, len(ids) - 1))
            edge = np.flatnonzero(inside & (ids[where] == other) & (tile[where] != tile)) if len(ids) else np.empty(0, int)
            a.append(branch[edge])
            b.append(branch[where[edge]])
            s.append(np.minimum(level[edge], level[where[edge]]))
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        names, tops = every("top_id"), every("top")
        sort = np.argsort(names)
        names, tops = names[sort], tops[sort].tolist()
        a, b = np.searchsorted(names, a), np.searchsorted(names, b)
        # The highest saddle of each two branches, by falling level.
        low, high = np.minimum(a, b), np.maximum(a, b)
        by = np.lexsort((-s, high, low))
        low, high, s = low[by], high[by], s[by]
        first = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])] if len(low) else np.empty(0, bool)
        low, high, s = low[first], high[first], s[first]
        by = np.argsort(-s, kind="stable")
        root, main, rows = list(range(len(names))), list(range(len(names))), []
        for p, q, level_ in zip(low[by].tolist(), high[by].tolist(), s[by].tolist()):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            while root[q] != q:
                root[q] = root[root[q]]
                q = root[q]
            if p != q:
                if tops[main[p]] < tops[main[q]]:
                    p, q = q, p
                rows.append((len(rows), int(names[main[q]]), int(names[main[p]]), level_))
                root[q] = p
        k, branch_, parent, ends = zip(*rows) if rows else ((),) * 4
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(k), pa.int64()), pa.array(k, pa.int64()), pa.array(branch_, pa.int64()), pa.array(parent, pa.int64()), pa.array(ends, pa.float32())], schema=out)

    columns = ["m", "tile", "border_id", "border_level", "border_branch", "a", "b", "saddle", "top_id", "top"]
    return trees.select(*columns).groupBy("m").applyInArrow(run, ATTACHED)


def located(trees: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Elements as ``m, id, branch, level``; the closed branches as ``m, tile, k, branch, parent, ends``; and what branches grow by within a
    tile, ``m, branch, level, add``: their own elements, and closed branches that end in them.

    The open branches' ends are sent to every task; they are as many as borders have peaks, and were held by one task before.
    """
    held: dict[int, list] = {}
    for r in open_.select("m", "branch", "parent", "ends").toLocalIterator():
        held.setdefault(r["m"], []).append((r["branch"], r["parent"], r["ends"]))
    sent = trees.sparkSession.sparkContext.broadcast({m: tuple(np.array(c, t) for c, t in zip(zip(*v), ("<i8", "<i8", "<f4"))) for m, v in held.items()})

    def placed(b):
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        made: dict[int, Branches] = {}
        for i in range(b.num_rows):
            m = b.column("m")[i].as_py()
            if m not in made:
                made = {m: Branches(*sent.value.get(m, none))}
            read = lambda c, i=i: _read(b.column(c)[i], c)
            yield i, m, made[m], read

    def elements(batches):
        for b in batches:
            for _, m, ends, read in placed(b):
                branch, level = ends.at(read("branch"), read("level")), read("level")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(level), m)), pa.array(read("ids")), pa.array(branch), pa.array(level)], names=["m", "id", "branch", "level"])

    def closed(batches):
        for b in batches:
            for i, m, ends, read in placed(b):
                own = read("closed")
                columns = [np.full(len(own), m), np.full(len(own), b.column("tile")[i].as_py()), np.arange(len(own)), own, ends.at(read("parent"), read("ends"))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(read("ends"))], names=["m", "tile", "k", "branch", "parent", "ends"])

    def growth(batches):
        for b in batches:
            for _, m, ends, read in placed(b):
                branch, level = ends.at(read("branch"), read("level")), read("level")
                own, size = np.unique(branch, return_counts=True)
                sizes = dict(zip(own.tolist(), size.tolist()))
                parent = ends.at(read("parent"), read("ends"))
                added = []
                for c, p in zip(read("closed").tolist(), parent.tolist()):  # a branch ends after those that end in it
                    added.append(sizes.get(c, 0))
                    sizes[p] = sizes.get(p, 0) + added[-1]
                both = np.concatenate([branch, parent]), np.concatenate([level, read("ends")]), np.concatenate([np.ones(len(branch), np.int64), np.array(added, np.int64)])
                by = np.lexsort((both[1], both[0]))
                branch, level, add = (x[by] for x in both)
                first = np.flatnonzero(np.r_[True, (branch[1:] != branch[:-1]) | (level[1:] != level[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), m)), pa.array(branch[first]), pa.array(level[first]), pa.array(np.add.reduceat(add, first))], names=["m", "branch", "level", "add"])

    own = trees.select("m", "tile", "ids", "level", "branch", "closed", "parent", "ends")
    return (
        own.mapInArrow(elements, "m long, id long, branch long, level float"),
        own.mapInArrow(closed, "m long, tile long, k long, branch long, parent long, ends float"),
        own.mapInArrow(growth, "m long, branch long, level float, add long"),
    )


def open_growth(open_: DataFrame, growth: DataFrame) -> DataFrame:
    """What open branches grow by where other open ones end in them: ``m, branch, level, add``."""
    sizes = growth.groupBy("m", "branch").agg(F.sum("add").alias("size"))
    own = open_.join(sizes, ["m", "branch"], "left").fillna(0, ["size"])

    def run(key, table):
        by = np.argsort(table.column("k").to_numpy())
        branch, parent, size = (table.column(c).to_numpy()[by].tolist() for c in ("branch", "parent", "size"))
        total: dict[int, int] = {}
        add = []
        for b, p, n in zip(branch, parent, size):
            add.append(n + total.get(b, 0))
            total[p] = total.get(p, 0) + add[-1]
        return pa.table({"m": pa.array([key[0].as_py()] * len(by), pa.int64()), "branch": pa.array(parent, pa.int64()), "level": table.column("ends").to_numpy()[by], "add": pa.array(add, pa.int64())})

    return own.groupBy("m").applyInArrow(run, "m long, branch long, level float, add long")


def integrals(levels: DataFrame, ends: DataFrame, e: float, h: float, most: int = LEVELS) -> DataFrame:
    """``m, branch, level, inner``: the integral along a branch from its end up to each of its levels. ``levels(m, branch, level, add)`` are distinct;
    branches of more than ``most`` levels are cut into ranges, so that no window is longer."""
    many = levels.groupBy("m", "branch").agg(F.count("*").alias("n"), F.min("level").alias("least"), F.max("level").alias("peak")).where(F.col("n") > most).collect()  # at most a ``most``-th of all levels
    part = F.lit(0)
    for r in many:
        own = levels.where((F.col("m") == r["m"]) & (F.col("branch") == r["branch"]))
        pieces = -(-r["n"] // most) * 2
        cuts = own.stat.approxQuantile("level", [k / pieces for k in range(1, pieces)], 0.1 / pieces)
        part = F.when((F.col("m") == r["m"]) & (F.col("branch") == r["branch"]), sum((F.when(F.col("level") <= c, 1).otherwise(0) for c in cuts), F.lit(0))).otherwise(part)
    cut = levels.withColumn("part", part)  # of falling levels
    whole = ["m", "branch"]
    after = Window.partitionBy(*whole).orderBy("part")
    tops = cut.groupBy(*whole, "part").agg(F.sum("add").alias("sum"), F.max("level").alias("top"))
    tops = tops.withColumn("above", F.coalesce(F.sum("sum").over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next_top", F.lead("top").over(after)).drop("sum", "top")
    down = Window.partitionBy(*whole, "part").orderBy(F.desc("level"))
    sized = cut.join(tops, [*whole, "part"]).join(ends.select(*whole, "ends"), whole, "left")
    size = F.col("above") + F.sum("add").over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.lead("level").over(down), "next_top", "ends", F.lit(0.0).cast("float")).cast("double")
    height = F.pow(F.col("level").cast("double"), F.lit(h + 1)) - F.pow(below, F.lit(h + 1))
    pieces_ = sized.select(*whole, "part", "level", (F.pow(size.cast("double"), F.lit(e)) * height / (h + 1)).alias("piece"))
    rest = pieces_.groupBy(*whole, "part").agg(F.sum("piece").alias("sum"))
    rest = rest.withColumn("under", F.coalesce(F.sum("sum").over(after.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))).drop("sum")
    up = Window.partitionBy(*whole, "part").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return pieces_.withColumn("run", F.sum("piece").over(up)).join(rest, [*whole, "part"]).select(*whole, "level", (F.col("run") + F.col("under")).alias("inner"))


def _below(rows: DataFrame, by: list[str]) -> DataFrame:
    """``m, branch, below``: what is under each branch's end, from ``drop`` (the integral of its parent up to there) and ``base`` (what is under a
    parent that is in no group), for groups in which every branch ends after those that end in it."""

    def run(key, table):
        order = np.argsort(-table.column("k").to_numpy())
        branch, parent, drop, base = (table.column(c).take(pa.array(order)).to_pylist() for c in ("branch", "parent", "drop", "base"))
        out: dict[int, float] = {}
        for x, p, d, under in zip(branch, parent, drop, base):
            out[x] = d + (out[p] if p in out else under or 0.0)
        return pa.table({"m": pa.array([key[0].as_py()] * len(out), pa.int64()), "branch": pa.array(list(out), pa.int64()), "below": pa.array(list(out.values()), pa.float64())})

    return rows.groupBy(*by).applyInArrow(run, "m long, branch long, below double")


def tfce_tiled(maps: DataFrame, grid: tuple[int, int, int], tiles: tuple[int, int, int], connectivity: int = 26, E: float = 0.5, H: float = 2.0, two_sided: bool = True, most: int = LEVELS) -> DataFrame:
    """The exact transform of ``map_id, element_id, value`` on ``grid``, cut into boxes of ``tiles``: the same rows with ``enh``.

    No task holds a map: a tile, a map's borders, or ``most`` levels of a branch are the most. Elements that are absent count as 0, non-finite
    values as 0; equal values, maps without a positive element and tiles larger than the grid are fine. ``map_id`` is a whole number.
    """
    grid, tiles = tuple(map(int, grid)), tuple(min(int(t), int(g)) for t, g in zip(tiles, grid))
    tree.tfce(np.zeros(1, np.float32), tree.Grid((1, 1, 1), connectivity), E, H)  # exponents and connectivity are checked here
    if min(tiles) < 1:
        raise ValueError("tiles have three sizes of 1 or more")
    bad = maps.where((F.col("element_id") < 0) | (F.col("element_id") >= int(np.prod(grid)))).select("element_id").first()
    if bad is not None:
        raise ValueError(f"an element lies outside 0..{int(np.prod(grid)) - 1}")
    used = maps if two_sided else maps.where("value > 0")
    trees = scratch(tile_trees(used, grid, tiles, connectivity), "tiles")
    open_ = scratch(joined_borders(trees, grid, connectivity), "open")
    elements, closed, growth = located(trees, open_)
    closed, growth = scratch(closed, "closed"), scratch(growth, "growth")
    levels = growth.unionByName(open_growth(open_, growth)).groupBy("m", "branch", "level").agg(F.sum("add").alias("add"))
    ends = closed.select("m", "branch", "parent", "ends").unionByName(open_.select("m", "branch", "parent", "ends"))
    inner = scratch(integrals(scratch(levels, "levels"), ends, E, H, most), "integrals")
    at_end = inner.select("m", F.col("branch").alias("parent"), F.col("level").alias("ends"), F.col("inner").alias("drop"))
    under_open = _below(open_.join(at_end, ["m", "parent", "ends"]).withColumn("base", F.lit(0.0)), ["m"])
    under_open = scratch(under_open, "under-open")
    base = under_open.select("m", F.col("branch").alias("parent"), F.col("below").alias("base"))
    under_closed = _below(closed.join(at_end, ["m", "parent", "ends"]).join(base, ["m", "parent"], "left"), ["m", "tile"])
    under = under_open.unionByName(under_closed)
    values = elements.join(inner, ["m", "branch", "level"]).join(under, ["m", "branch"], "left")
    enh = F.when(F.col("m") % 2 == 0, 1.0).otherwise(-1.0) * (F.col("inner") + F.coalesce("below", F.lit(0.0)))
    done = values.select(F.floor(F.col("m") / 2).alias("_map"), F.col("id").alias("_id"), enh.cast("float").alias("enh"))
    same = (F.col("map_id").cast("long") == F.col("_map")) & (F.col("element_id").cast("long") == F.col("_id"))
    return maps.select("map_id", "element_id", "value").join(done, same, "left").select("map_id", "element_id", F.col("value").cast("float").alias("value"), F.coalesce("enh", F.lit(0.0).cast("float")).alias("enh"))
