"""Points near other points, and regions around points.

Points are split into Voronoi cells around pivots; a point is copied into every further cell that the triangle
inequality leaves possible, and each cell is searched with a vantage-point tree under the exact great-circle metric.
Pivots are drawn from the points themselves, so crowded places get more of them. A cell that still is too large for a
task is cut into blocks that are joined pair by pair; nothing is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kittiwake.runtime import cut, partitions_for

RADIUS_M = 6371008.8
#: Metres that cover rounding in distances between unit vectors.
SLACK_M = 1e-5


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Unit vectors of points in degrees."""
    a, o = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    c = np.cos(a)
    return np.stack([c * np.cos(o), c * np.sin(o), np.sin(a)], axis=-1)


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Metres between unit vectors, with broadcasting."""
    half = np.sqrt(((a - b) ** 2).sum(-1)) / 2
    return 2 * RADIUS_M * np.arcsin(np.minimum(half, 1.0))


class VantageTree:
    """Vantage-point tree over unit vectors; queries go down the tree in bulk."""

    def __init__(self, points: np.ndarray, leaf: int = 48):
        self.points, self.leaf = points, leaf
        self.root = self._build(np.arange(len(points)))

    def _build(self, own: np.ndarray):
        if len(own) <= self.leaf:
            return own
        d = great_circle(self.points[own], self.points[own[0]])
        # the farthest point sees the others at the most different distances
        vantage = self.points[own[int(np.argmax(d))]]
        d = great_circle(self.points[own], vantage)
        radius = float(np.median(d))
        inner = d <= radius
        if inner.all() or not inner.any():
            return own
        return vantage, radius, self._build(own[inner]), self._build(own[~inner])

    def within(self, queries: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) index arrays at most ``radius`` metres apart, in pieces."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            if not len(asked):
                continue
            if isinstance(node, np.ndarray):
                step = max(1, 2_000_000 // max(1, len(node)))
                for at in range(0, len(asked), step):
                    some = asked[at : at + step]
                    q, p = np.nonzero(great_circle(queries[some][:, None, :], self.points[node][None, :, :]) <= radius)
                    if len(q):
                        yield some[q], node[p]
                continue
            vantage, middle, inner, outer = node
            d = great_circle(queries[asked], vantage)
            stack.append((inner, asked[d <= middle + radius + SLACK_M]))
            stack.append((outer, asked[d >= middle - radius - SLACK_M]))


def spread_pivots(points: np.ndarray, apart: float) -> np.ndarray:
    """Greedy subset of unit vectors that are more than ``apart`` metres from each other."""
    keep = np.ones(len(points), bool)
    for k in range(len(points)):
        if keep[k]:
            near = great_circle(points[k + 1 :], points[k]) <= apart
            keep[k + 1 :] &= ~near
    return points[keep]


class Voronoi:
    """Nearest pivot of a point and the further cells it has to be copied to."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        n = max(1, int(math.sqrt(len(pivots))))
        self.tops = pivots[np.linspace(0, len(pivots) - 1, n).astype(int)]
        # one row a top pivot; at most sqrt(P) * P distances
        self.from_top = np.stack([great_circle(pivots, t) for t in self.tops])

    def cells(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, home?) rows: a point goes to cell i if d(i) <= d(nearest) + 2 reach, which leaves out only
        cells that hold nothing within reach."""
        nearest_top = np.concatenate([np.argmax(points[k : k + 4096] @ self.tops.T, axis=1) for k in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)
        rows, cells, homes = [], [], []
        for t in np.unique(nearest_top):
            own = np.nonzero(nearest_top == t)[0]
            for at in range(0, len(own), 512):
                some = own[at : at + 512]
                far = great_circle(points[some], self.tops[t]).max()
                # every pivot that can matter lies this near to the top pivot
                near = np.nonzero(self.from_top[t] <= 2 * far + 2 * reach[some].max() + 1.0)[0]
                d = great_circle(points[some][:, None, :], self.pivots[near][None, :, :])
                home = d.argmin(1)
                hit = d <= d.min(1)[:, None] + 2 * reach[some][:, None] + SLACK_M
                r, c = np.nonzero(hit)
                rows.append(some[r])
                cells.append(near[c])
                homes.append(home[r] == c)
        if not rows:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def usable(geo: Column, lat: str = "_1", lon: str = "_2") -> Column:
    """Neither null nor NaN nor infinite, in range, and not (0, 0)."""
    a, o = geo[lat], geo[lon]
    return a.isNotNull() & o.isNotNull() & (F.abs(a) <= 90) & (F.abs(o) <= 180) & ~((a == 0) & (o == 0))


def sample_pivots(points: DataFrame, rows: int, cell_target: int, max_pivots: int, apart: float) -> np.ndarray:
    """Pivots as unit vectors: the coordinates with the smallest hashes, at most ``max_pivots``, thinned to ``apart``
    metres. Only that bounded sample reaches the driver; every point is assigned afterwards."""
    wanted = int(min(max_pivots, max(1, math.ceil(rows / cell_target))))
    h = F.xxhash64("lat", "lon")
    some = points.select("lat", "lon").where(F.pmod(h, F.lit(max(1, rows // (wanted * 8)))) == 0).distinct().orderBy(h).limit(wanted).collect()
    if not some:
        some = points.select("lat", "lon").limit(1).collect()
    at = np.array([(r[0], r[1]) for r in some], float).reshape(-1, 2)
    return spread_pivots(unit(at[:, 0], at[:, 1]), apart)


def ring_ball(ring: np.ndarray) -> tuple[float, float, float]:
    """Centre (degrees) and metres of a ball around a ring whose edges are straight in degrees.

    A path straight in degrees is no shorter than the great circle, which bounds the ball by the ring's box."""
    (a0, o0), (a1, o1) = ring.min(0), ring.max(0)
    lat, lon = (a0 + a1) / 2, (o0 + o1) / 2
    flat = 0.0 if a0 <= 0 <= a1 else min(abs(a0), abs(a1))
    reach = math.hypot(math.radians((a1 - a0) / 2), math.radians((o1 - o0) / 2) * math.cos(math.radians(min(flat, 90))))
    return lat, lon, min(math.pi, reach) * RADIUS_M + 1.0


def in_ring(lat: np.ndarray, lon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Even-odd test in degrees, the longitude taken plus or minus 360 where needed."""
    found = np.zeros(len(lat), bool)
    a, b = ring, np.roll(ring, -1, axis=0)
    for turn in (-360.0, 0.0, 360.0):
        x = lon + turn
        odd = np.zeros(len(lat), bool)
        for (y0, x0), (y1, x1) in zip(a, b):
            if y0 == y1:
                continue
            across = (y0 > lat) != (y1 > lat)
            odd ^= across & (x < x0 + (lat - y0) * (x1 - x0) / (y1 - y0))
        found |= odd
    return found


_ASSIGNED = "cell int, home boolean, id long, lat double, lon double, ring binary"
_FOUND = "kind string, id_a long, id_b long"


def _assign(pivots: np.ndarray, reach_m: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voronoi = Voronoi(pivots)
        for b in batches:
            lat, lon = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            rows, cells, home = voronoi.cells(unit(lat, lon), np.full(len(lat), reach_m))
            # a pair of two homes i < j is found in j alone
            own = np.full(len(lat), -1)
            own[rows[home]] = cells[home]
            keep = home | (cells > own[rows])
            rows, cells, home = rows[keep], cells[keep], home[keep]
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype("int32")), pa.array(home), b.column(0).take(pa.array(rows)), pa.array(lat[rows]), pa.array(lon[rows]), pa.nulls(len(rows), pa.binary())], names=["cell", "home", "id", "lat", "lon", "ring"])

    return run


def _assign_regions(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voronoi = Voronoi(pivots)
        for b in batches:
            out = []
            for i, ring in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                corners = [(float(c["_1"]), float(c["_2"])) for c in ring or [] if c and c["_1"] is not None and c["_2"] is not None]
                corners = np.array([c for c in corners if math.isfinite(c[0]) and math.isfinite(c[1])]).reshape(-1, 2)
                if len(corners) < 3:
                    continue
                lat, lon, reach = ring_ball(corners)
                _, cells, _ = voronoi.cells(unit(np.array([lat]), np.array([lon])), np.array([reach]))
                out += [(int(c), i, lat, lon, corners.tobytes()) for c in cells]
            c, i, lat, lon, ring = zip(*out) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array([False] * len(c), pa.bool_()), pa.array(i, pa.int64()), pa.array(lat, pa.float64()), pa.array(lon, pa.float64()), pa.array(ring, pa.binary())], names=["cell", "home", "id", "lat", "lon", "ring"])

    return run


def _search(radius_m: float, near: bool):
    def frame(held: list[np.ndarray]) -> pd.DataFrame:
        a, b = np.concatenate(held, axis=1)
        return pd.DataFrame({"kind": "near", "id_a": a, "id_b": b})

    def pairs(index: np.ndarray, at: np.ndarray, asked: np.ndarray, q_at: np.ndarray, same: bool) -> Iterator[pd.DataFrame]:
        if not len(index) or not len(asked):
            return
        held, n = [], 0
        for q, p in VantageTree(at).within(q_at, radius_m):
            if same:
                q, p = q[q < p], p[q < p]
            a, b = asked[q], index[p]
            held.append(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b])
            n += len(a)
            if n > 500_000:
                yield frame(held)
                held, n = [], 0
        if held:
            yield frame(held)

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # pairs leave as they are found; only the cell itself is held
        _, first, second = key
        pdf = pd.concat(parts)
        zone = pdf["ring"].notna().to_numpy()
        pts, zones = pdf[~zone], pdf[zone]
        ids, lat, lon, home, block = (pts[k].to_numpy() for k in ("id", "lat", "lon", "home", "block"))
        xyz = unit(lat, lon)
        if near and first == second:
            yield from pairs(ids[home], xyz[home], ids[home], xyz[home], True)
            yield from pairs(ids[home], xyz[home], ids[~home], xyz[~home], False)
        elif near:
            f, s = block == first, block == second
            yield from pairs(ids[home & f], xyz[home & f], ids[s], xyz[s], False)
            yield from pairs(ids[home & s], xyz[home & s], ids[f & ~home], xyz[f & ~home], False)
        if len(zones) and home.any():
            own, o_lat, o_lon = ids[home], lat[home], lon[home]
            tree = VantageTree(xyz[home])
            for z in zones.itertuples():
                ring = np.frombuffer(z.ring, float).reshape(-1, 2)
                _, _, reach = ring_ball(ring)
                for _, p in tree.within(unit(np.array([z.lat]), np.array([z.lon])), reach):
                    p = p[in_ring(o_lat[p], o_lon[p], ring)]
                    yield pd.DataFrame({"kind": "in", "id_a": z.id, "id_b": own[p]})

    return run


def locate(points: DataFrame, regions: DataFrame | None = None, *, radius_m: float | None = 30.0, point_id: str = "id", geo: str = "geopoint", region_id: str = "zone_id", ring: str = "ring", cell_target: int = 4096, max_pivots: int = 16384, cell_limit: int = 40000) -> DataFrame:
    """Pairs of near points and of regions with the points inside: (kind, id_a, id_b).

    kind ``near``: two points with different ids at most ``radius_m`` metres apart, id_a < id_b (left out if
    ``radius_m`` is None). kind ``in``: region id_a holds point id_b. Points that are not ``usable`` or have no id, and
    rings with fewer than three finite corners, are in no pair. Rows are distinct, also if a row is repeated. Empty
    tables give no rows. Other columns are not read.

    Cells hold ``cell_target`` points on average until ``max_pivots`` is reached; with more than ``cell_limit`` rows a
    cell is cut into blocks and each pair of blocks becomes a task. Pairs are sorted out again only where an id has several
    places. Broadcast: pivots only, 24 bytes each, at most
    ``max_pivots``.
    """
    spark = points.sparkSession
    reach = float(radius_m or 0.0)
    pts = _distinct_points(points, point_id, geo)
    rows = pts.count()
    if not rows:
        return spark.createDataFrame([], _FOUND)
    again = pts.select("id").distinct().count() < rows
    pivots = sample_pivots(pts, rows, cell_target, max_pivots, 8 * reach)
    placed = pts.mapInArrow(_assign(pivots, reach), _ASSIGNED)
    if regions is not None:
        zones = regions.where(regions[region_id].isNotNull()).select(regions[region_id].cast("long").alias("id"), regions[ring].alias("ring"))
        again = again or bool(zones.groupBy("id").count().where("count > 1").limit(1).count())
        placed = placed.unionAll(zones.mapInArrow(_assign_regions(pivots), _ASSIGNED))
    placed = cut(placed)
    # one row a cell, at most max_pivots of them
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell_limit).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", "lat", "lon"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = (
        placed.join(F.broadcast(sizes), "cell")
        .withColumn("block", F.when(F.col("ring").isNull(), own).otherwise(-1))
        .withColumn("other", F.explode(others))
        .withColumn("b0", F.when(F.col("ring").isNotNull(), F.col("other")).otherwise(F.least("block", "other")))
        .withColumn("b1", F.when(F.col("ring").isNotNull(), F.col("other")).otherwise(F.greatest("block", "other")))
        .select("cell", "b0", "b1", "home", "id", "lat", "lon", "ring", "block")
    )
    n = partitions_for(spark, rows, cell_target * 8)
    found = spread.repartition(n, "cell", "b0", "b1").groupBy("cell", "b0", "b1").applyInPandas(_search(reach, radius_m is not None), _FOUND)
    # two rows with different ids meet in one cell and one pair of blocks only; ids with several places may meet again
    return found.distinct() if again else found


def _distinct_points(points: DataFrame, point_id: str, geo: str) -> DataFrame:
    """(id, lat, lon) of usable points, each row once."""
    g = points[geo]
    return cut(points.where(points[point_id].isNotNull() & usable(g)).select(points[point_id].cast("long").alias("id"), g["_1"].cast("double").alias("lat"), g["_2"].cast("double").alias("lon")).distinct())


def locate_classes(points: DataFrame, regions: DataFrame | None = None, *, point_id: str = "id", geo: str = "geopoint", **options) -> DataFrame:
    """The same in classes: points at one place are a class, told by its smallest id.

    kind ``same``: id_b stands where its class id_a does, id_a < id_b. ``near`` and ``in``: as ``locate`` gives them, for
    the classes alone. A place with a third of all points adds a row for each of them, not a pair for each two."""
    pts = _distinct_points(points, point_id, geo)
    rep = cut(pts.groupBy("lat", "lon").agg(F.min("id").alias("rep")))
    same = pts.join(rep, ["lat", "lon"]).where(F.col("id") != F.col("rep")).select(F.lit("same").alias("kind"), F.col("rep").alias("id_a"), F.col("id").alias("id_b")).distinct()
    at = rep.select(F.col("rep").alias(point_id), F.struct(F.col("lat").alias("_1"), F.col("lon").alias("_2")).alias(geo))
    return same.unionAll(locate(at, regions, point_id=point_id, geo=geo, **options))
