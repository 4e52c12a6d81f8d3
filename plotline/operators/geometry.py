"""Simplification of polygons that keeps shared borders shared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees that a border may move.
TOLERANCE = 1e-4
_POINT = "struct<x:double,y:double>"


def douglas_peucker(points: np.ndarray, tolerance: float, least: int) -> np.ndarray:
    """Indices of the points that are kept: both ends, every point that is farther than ``tolerance`` from the line between
    its kept neighbours, and the farthest ones until ``least`` are kept (as far as there are so many)."""
    n = len(points)
    kept = {0, n - 1}
    todo = [(0, n - 1)]
    waiting: list[tuple[float, int, int, int]] = []

    def farthest(a: int, b: int) -> tuple[float, int]:
        p, q, r = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = np.hypot(*d)
        along = np.clip((r - p) @ d / (length * length), 0, 1) if length else np.zeros(len(r))
        away = np.hypot(*(r - p - along[:, None] * d).T)
        i = int(away.argmax())
        return float(away[i]), a + 1 + i

    while todo or (len(kept) < least and waiting):
        if todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            away, i = farthest(a, b)
            if away <= tolerance:
                waiting.append((away, i, a, b))
                continue
        else:
            waiting.sort()
            _, i, a, b = waiting.pop()
        kept.add(i)
        todo += [(a, i), (i, b)]
    return np.array(sorted(kept))


def _rings(features: DataFrame, id_col: str, geometry: str) -> DataFrame:
    """(id, kind, polygon, ring, points): each ring's points once, without the closing one."""
    kind = F.get_json_object(geometry, "$.type")
    coords = F.get_json_object(geometry, "$.coordinates")
    many = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords), "array<array<array<array<double>>>>")
    d = features.where(kind.isin("Polygon", "MultiPolygon")).select(F.col(id_col).alias("id"), kind.alias("kind"), F.posexplode(many).alias("polygon", "rings")).select("id", "kind", "polygon", F.posexplode("rings").alias("ring", "c"))
    points = F.transform(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return d.select("id", "kind", "polygon", "ring", points.alias("points")).where(F.size("points") >= 3)


def _junctions(rings: DataFrame) -> DataFrame:
    """(x, y) of the points with other than two different neighbours over all rings: there borders part."""
    n = F.size("points")
    beside = F.flatten(F.transform("points", lambda p, i: F.array(F.struct(p.alias("v"), F.col("points")[(i + 1) % n].alias("w")), F.struct(p.alias("v"), F.col("points")[(i + n - 1) % n].alias("w")))))
    pairs = rings.select(F.inline(beside)).distinct()
    return pairs.groupBy("v").count().where("count <> 2").select("v.x", "v.y")


def _arcs(rings: DataFrame) -> DataFrame:
    """(id, kind, polygon, ring, arcs): each ring from a junction (or its smallest point) on, cut at the junctions."""
    by = ["id", "kind", "polygon", "ring"]
    flagged = rings.select(*by, F.posexplode("points").alias("at", "p")).select(*by, "at", "p.x", "p.y").join(_junctions(rings).withColumn("j", F.lit(True)), ["x", "y"], "left")
    whole = flagged.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", F.struct("x", "y").alias("p"), F.coalesce("j", F.lit(False)).alias("j")))).alias("v"))
    first = F.coalesce(F.get(F.filter("v", lambda v: v["j"]), 0)["at"], F.array_sort(F.transform("v", lambda v: F.struct(v["p"].alias("p"), v["at"].alias("at"))))[0]["at"])
    turned = F.concat(F.slice("v", first + 1, F.size("v")), F.slice("v", F.lit(1), first), F.slice("v", first + 1, F.lit(1)))
    d = whole.select(*by, turned.alias("v"))
    inner = F.filter(F.sequence(F.lit(1), F.size("v") - 2), lambda i: F.col("v")[i]["j"])
    d = d.withColumn("cuts", F.concat(F.array(F.lit(0)), inner, F.array(F.size("v") - 1)))
    arcs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.transform(F.slice("v", F.col("cuts")[k] + 1, F.col("cuts")[k + 1] - F.col("cuts")[k] + 1), lambda v: v["p"]))
    return d.select(*by, arcs.alias("arcs"))


def _key(arc: Column) -> Column:
    return F.sha2(F.to_json(arc), 256)


def simplify(features: DataFrame, *, id_col: str = "id", geometry: str = "geometry", tolerance: float = TOLERANCE) -> DataFrame:
    """(id, geometry): the polygons and multipolygons of ``features`` (GeoJSON text) with simpler borders.

    Rings are cut into arcs where borders part. An arc that two rings share, in either direction, is one row and simplified
    once, so that neighbours keep equal borders and no gap opens. Points where borders part stay, and so many others that no
    ring falls together: a ring of one arc keeps four, one of two arcs three each. Other geometries, null ones and rings of
    fewer than three points are left out; a feature without any ring left has no row. Tasks hold a ring at a time."""
    rings = _arcs(_rings(features, id_col, geometry))
    by = ["id", "kind", "polygon", "ring"]
    cut = rings.select(*by, F.size("arcs").alias("n"), F.posexplode("arcs").alias("k", "arc"))
    turned = F.reverse("arc")
    cut = cut.withColumn("back", turned < F.col("arc")).withColumn("arc", F.when(F.col("back"), turned).otherwise(F.col("arc")))
    cut = cut.withColumn("key", _key(F.col("arc")))
    least = F.when(F.col("n") == 1, 4).when(F.col("n") == 2, 3).otherwise(2)
    arcs = cut.groupBy("key").agg(F.first("arc").alias("arc"), F.max(least).alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for arc, least in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                points = np.array([(p["x"], p["y"]) for p in arc], float)
                out.append([arc[i] for i in douglas_peucker(points, tolerance, least).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], names=["key", "simple"])

    simple = arcs.mapInArrow(run, f"key string, simple array<{_POINT}>")
    back = cut.select(*by, "k", "back", "key").join(simple, "key").withColumn("simple", F.when(F.col("back"), F.reverse("simple")).otherwise(F.col("simple")))
    whole = back.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "simple"))).alias("parts"))
    # each arc without its last point, which the next one begins with, and the first point again
    open_ = F.flatten(F.transform("parts", lambda p: F.slice(p["simple"], F.lit(1), F.size(p["simple"]) - 1)))
    ring = F.transform(F.concat(open_, F.slice(open_, 1, 1)), lambda p: F.array(p["x"], p["y"]))
    polygons = whole.select(*by, ring.alias("c")).groupBy("id", "kind", "polygon").agg(F.array_sort(F.collect_list(F.struct("ring", "c"))).alias("r"))
    every = polygons.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("polygon", F.transform("r", lambda r: r["c"]).alias("c")))).alias("p"))
    coords = F.transform("p", lambda p: p["c"])
    text = F.when(F.col("kind") == "Polygon", F.to_json(F.struct(F.col("kind").alias("type"), coords[0].alias("coordinates")))).otherwise(F.to_json(F.struct(F.col("kind").alias("type"), coords.alias("coordinates"))))
    return every.select(F.col("id").alias(id_col), text.alias("geometry"))
