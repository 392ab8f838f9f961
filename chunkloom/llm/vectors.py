"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact in double precision.

Vectors are compared inside a group (label, dimension). All vectors are turned into the eigenbasis of their second moments,
so that the leading coordinates hold most of a product. Each group is sorted by its first coordinate and packed into tiles
of up to ``TILE`` vectors; two tiles are compared only if the boxes that hold their leading coordinates come as close as
two unit vectors at the threshold must. In a pair of tiles the products of the leading coordinates are summed first; what
the rest can add is bounded by the product of the norms of the rests, and a pair is dropped as soon as the bound falls
below the threshold. Every comparison hands on counts of links and a spanning forest, never all links.

Scale: the sort is a range partitioning on (group, coordinate, hash of the id), which splits a label or a vector that a
third of all rows share. The comparison is exact and so quadratic in a group's size, less the pruned tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_rows, read_table
from .components import Forest, components

THRESHOLD = 0.98
TILE = 2048
#: Leading coordinates kept as a tile's box, and those after which partial products are tested.
BOX, STEPS = 8, (8, 16, 32)
_ROWS = 256
#: Products this near the threshold are computed again from the vectors as they came.
_CLOSE = 1e-9


def _by_dimension(rows: Iterator[tuple]) -> Iterator[tuple[int, list[tuple], np.ndarray]]:
    """(dim, rows, their unit vectors) of up to ``TILE`` rows (..., dim, packed) of one dimension."""
    held: dict[int, list[tuple]] = {}
    for row in rows:
        own = held.setdefault(row[-2], [])
        own.append(row)
        if len(own) == TILE:
            yield row[-2], own, _unit(np.frombuffer(b"".join(r[-1] for r in own), np.float64).reshape(len(own), -1))
            held[row[-2]] = []
    for dim, own in held.items():
        if own:
            yield dim, own, _unit(np.frombuffer(b"".join(r[-1] for r in own), np.float64).reshape(len(own), -1))


def _moments(rows: Iterator[tuple]) -> Iterator[tuple]:
    sums: dict[int, np.ndarray] = {}
    for dim, _, v in _by_dimension(rows):
        sums[dim] = sums.get(dim, 0) + v.T @ v
    for dim, m in sums.items():
        for i in range(dim):
            for j in range(i + 1):
                yield dim, i, j, float(m[i, j])


def _unit(m: np.ndarray) -> np.ndarray:
    scaled = m / np.abs(m).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _pack_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Valid vectors as bytes of doubles; anything null or not finite, or without length, has none."""
    for vec_id, label, v in rows:
        packed = None
        if label is not None and v and None not in v:
            m = np.array(v, np.float64)
            if np.isfinite(m).all() and m.any():
                packed = m.tobytes()
        yield vec_id, label, len(v) if packed else None, packed


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the eigenvectors of the second moments of all unit vectors, most energy first. Only sums reach the driver."""
    parts = map_rows(vectors, lambda: _moments, "dim int, i int, j int, s double")
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect():  # dim^2 / 2 numbers
        m = sums.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return {dim: np.linalg.eigh(m)[1][:, ::-1] for dim, m in sums.items()}


def _tiles(basis: dict[int, np.ndarray], tile: int):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() + 1) << 24
        held, group = [], None

        def close() -> tuple:
            nonlocal number
            number += 1
            vectors = b"".join(p for _, p in held)
            turned = _unit(np.frombuffer(vectors, np.float64).reshape(len(held), -1)) @ basis[group[1]][:, :BOX]
            ids = [i for i, _ in held]
            return number, *group, turned.min(axis=0).tolist(), turned.max(axis=0).tolist(), ids, vectors

        for vec_id, label, dim, packed, _, _ in rows:
            if held and (group != (label, dim) or len(held) == tile):
                yield close()
                held = []
            group = (label, dim)
            held.append((vec_id, packed))
        if held:
            yield close()

    return run


def _first_coordinate(basis: dict[int, np.ndarray]):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for dim, own, v in _by_dimension(rows):
            for row, first in zip(own, (v @ basis[dim][:, 0]).tolist(), strict=True):
                yield *row, first

    return run


def close_pairs(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of the pairs of rows whose cosine reaches the threshold, in pieces."""
    ta, tb = _unit(a) @ basis, _unit(b) @ basis
    steps = [s for s in STEPS if s < basis.shape[0]] + [basis.shape[0]]
    rest = [(np.sqrt((ta[:, s:] ** 2).sum(axis=1)), np.sqrt((tb[:, s:] ** 2).sum(axis=1))) for s in steps]
    least = threshold - _CLOSE
    for at in range(0, len(ta), _ROWS):
        x = ta[at : at + _ROWS]
        product = x[:, : steps[0]] @ tb[:, : steps[0]].T
        p, q = np.nonzero(product + rest[0][0][at : at + _ROWS, None] * rest[0][1] >= least)
        product = product[p, q]
        for k in range(1, len(steps)):
            if not len(p):
                break
            product = product + np.einsum("ij,ij->i", x[p, steps[k - 1] : steps[k]], tb[q, steps[k - 1] : steps[k]])
            on = product + rest[k][0][at + p] * rest[k][1][q] >= least
            p, q, product = p[on], q[on], product[on]
        sure = product >= threshold + _CLOSE
        for i in np.nonzero(~sure)[0]:
            u, v = a[at + p[i]], b[q[i]]
            sure[i] = u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold
        if sure.any():
            yield at + p[sure], q[sure]


def _compare(basis: dict[int, np.ndarray], threshold: float):
    """Rows of (pair, side, tile, dim, vectors), sides 0 and 1 together, 2 a tile with itself. Out: (row, links seen, root)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        left = None
        for _, side, tile, dim, packed in rows:
            mine = (tile, np.frombuffer(packed, np.float64).reshape(-1, dim))
            if side == 0:
                left = mine
                continue
            (ta, a), (tb, b) = (mine if side == 2 else left), mine
            shift = 0 if side == 2 else len(a)
            n = len(b) + shift
            forest, links = Forest(n), np.zeros(n, np.int64)
            for p, q in close_pairs(a, b, basis[dim], threshold):
                if side == 2:
                    on = p != q
                    p, q = p[on], q[on]
                    links += np.bincount(p, minlength=n)
                else:
                    links += np.bincount(p, minlength=n) + np.bincount(q + shift, minlength=n)
                forest.link(p, q + shift)
            names = np.arange(n) + (tb << 16) if side == 2 else np.concatenate([np.arange(len(a)) + (ta << 16), np.arange(len(b)) + (tb << 16)])
            for i in np.nonzero(links)[0]:
                yield int(names[i]), int(links[i]), int(names[forest.root[i]])

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, as the contract of op4 has them.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
    nothing: n_links 0, component_id their own id. Vectors of different length do not link. Each row is a vector: repeated
    rows link with one another; kept is then true for each row whose id is its component's. Other columns are ignored.
    """
    if not 0 < threshold <= 1 or not 0 < tile <= 1 << 16:
        raise ValueError("threshold in (0, 1], tile in 1..65536")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = cut(map_rows(rows, lambda: _pack_rows, "vec_id long, label long, dim int, packed binary"))
    valid = packed.where("packed is not null")
    basis = bases(valid)
    placed = map_rows(valid, lambda: _first_coordinate(basis), "vec_id long, label long, dim int, packed binary, first double").withColumn("tie", F.xxhash64("vec_id", "packed"))
    order = ["label", "dim", "first", "tie"]
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_rows = placed.repartitionByRange(int(n), *order).sortWithinPartitions(*order, "vec_id")
    tiles = cut(map_rows(sorted_rows, lambda: _tiles(basis, tile), "tile long, label long, dim int, low array<double>, high array<double>, ids array<long>, vectors binary"))
    boxes = tiles.select("tile", "label", "dim", "low", "high")
    gap = F.aggregate(
        F.zip_with(F.zip_with("low", "other_high", lambda a, b: a - b), F.zip_with("other_low", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    # Tiles meet by bands of their first coordinate, as wide as two unit vectors at the threshold can be apart.
    width = max(float(np.sqrt(2 * (1 - threshold) + _CLOSE)), 1e-3)
    band = lambda c, more: (F.floor(F.col(c)[0] / width) + more).cast("int")
    others = boxes.select("label", "dim", F.explode(F.sequence(band("low", -1), band("high", 1))).alias("band"), *(F.col(c).alias(f"other_{c}") for c in ("tile", "low", "high")))
    banded = boxes.withColumn("band", F.explode(F.sequence(band("low", 0), band("high", 0))))
    near = banded.join(others, ["label", "dim", "band"]).where("tile <= other_tile").where(gap <= 2 * (1 - threshold) + _CLOSE)
    pairs = near.select("tile", "other_tile").distinct()
    pair = F.concat_ws(" ", "tile", "other_tile").alias("pair")
    own = F.when(F.col("tile") == F.col("other_tile"), 2).otherwise(0).alias("side")
    roles = pairs.select(pair, own, "tile").union(pairs.where("tile < other_tile").select(pair, F.lit(1).alias("side"), F.col("other_tile").alias("tile")))
    sent = roles.join(tiles.select("tile", "dim", "vectors"), "tile").select("pair", "side", "tile", "dim", "vectors")
    seen = cut(map_rows(sent.repartition("pair").sortWithinPartitions("pair", "side"), lambda: _compare(basis, threshold), "row long, n long, root long"))
    roots = components(seen.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = tiles.select("tile", F.posexplode("ids").alias("at", "vec_id")).select(F.expr("(tile << 16) + at").alias("row"), "vec_id")
    linked = named.join(seen.groupBy("row").agg(F.sum("n").alias("n_links")), "row", "left").join(roots.withColumnRenamed("id", "row"), "row", "left")
    linked = cut(linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "row").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = linked.join(smallest, "root").select("vec_id", "n_links", "component_id")
    alone = packed.where("packed is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.expr("vec_id <=> component_id"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT r.x AS vec_id, coalesce(max(c.n), 0)::BIGINT AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM reach r LEFT JOIN counts c ON c.x = r.x GROUP BY r.x
"""
