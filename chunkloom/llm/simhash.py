"""SimHash near-duplicates by tiled exact comparison.

Every whole text gets a 64-bit fingerprint. Equal fingerprints are one node. The distinct fingerprints are dealt into
tiles by their number of set bits (large ones are split by hash); two tiles are compared, with numpy exclusive-or and bit
counts, only if their numbers of set bits differ by no more than the radius, as otherwise no pair of them can be within
it. Inside a pair of tiles the same argument is used on the halves, or quarters, of the fingerprint. All links are found; each
comparison hands on a spanning forest of the links it saw, so a group of n near copies costs n edges and not n^2.

``similar_documents`` is for shingles of five words and a similarity of 0.8 or more: fingerprints of 256 bits, so that a radius
which loses no such pair leaves few others to check; tiles by the number of shingles too, as sets whose sizes differ by more
than a quarter are not that similar. The shingles of each close pair are then compared exactly. Of very many close
documents each is first checked with its ``NEAREST`` ones, and then with all that it is not linked to yet: a group of n near
copies needs no n^2 checks.

Scale: comparing exactly is quadratic in the number of distinct fingerprints, less the pruned tiles; a tile is at most
about ``TILE`` fingerprints, each pair of tiles is one record of the shuffle, and nothing is collected but counts of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, free_shuffles, fresh, map_rows, read_table
from .components import Forest, components

WORDS, RADIUS, HASH_SEED = 3, 3, 42
TILE = 65_536
#: Words of a shingle of ``similar_documents``; similar are sets of which NUM / DEN of the union are common.
SHINGLE, NUM, DEN = 5, 4, 5
#: Longs of a wide fingerprint. Of sets of similarity 0.8, 39 of its 256 bits differ on average, and 10 of the first 64; the radii
#: are five and four standard deviations more, three for sets of four and five shingles.
LONGS, WIDE_RADIUS, FIRST_RADIUS = 4, 68, 22
#: Close documents that each is checked with at first, in each pair of tiles.
NEAREST = 4
#: Bytes of shingles of a tile where all are checked: small ones up to so many, for many tasks, and then larger ones, so that each is sent less often.
SMALL_TILE, MANY_TILES, LARGE_TILE = 1 << 19, 32, 16 << 20
#: Sizes within a quarter of each other are in the same band or in neighbouring ones.
_BAND = 1.2501
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Pairs compared at once: both operands and the result stay in the cache.
_ROWS, _COLS = 64, 2048
#: Pairs of a pair of tiles from which quarters are taken and not halves.
_QUARTERS = 1 << 28


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes. No words (or null): 0."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    hash_of = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return hash_of(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((hash_of(joined[a:b], HASH_SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long: the fingerprint's bits) of every row."""

    def make():
        return lambda rows: ((doc_id, f - (1 << 64) if f >> 63 else f) for doc_id, f in ((d, fingerprint(t)) for d, t in rows))

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


def _parts(x: np.ndarray, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct tuples of set bits of the fingerprints' parts, and for each the rows that have it."""
    width = 64 // parts
    mask = np.uint64((1 << width) - 1)
    counts = np.stack([np.bitwise_count(x >> np.uint64(width * k) & mask) for k in range(parts)], axis=1).astype(np.int64)
    key = counts @ (65 ** np.arange(parts))
    order = np.argsort(key, kind="stable")
    _, first = np.unique(key[order], return_index=True)
    return counts[order[first]], np.split(order, first[1:])


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of the pairs within the radius, in pieces.

    Fingerprints are grouped by the set bits of their halves, in large tiles of their quarters; two groups whose counts differ
    by more than the radius in sum have no pair within it and are skipped. Which parts are taken changes the time only."""
    parts = 4 if len(a) * len(b) > _QUARTERS else 2
    (of_a, rows_of_a), (of_b, rows_of_b) = _parts(a, parts), _parts(b, parts)
    for g in range(len(of_a)):
        for k in np.nonzero(np.abs(of_b - of_a[g]).sum(axis=1) <= radius)[0]:
            rows_a, rows_b = rows_of_a[g], rows_of_b[k]
            x, y = a[rows_a], b[rows_b]
            for i in range(0, len(x), _ROWS):
                for j in range(0, len(y), _COLS):
                    near = np.bitwise_count(x[i : i + _ROWS, None] ^ y[None, j : j + _COLS]) <= radius
                    if near.any():
                        p, q = np.nonzero(near)
                        yield rows_a[i + p], rows_b[j + q]


def _pack(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (bits, part, fp) to one row of each tile, its fingerprints as the bytes of 64-bit integers."""
    for (bits, part), own in groupby(rows, key=lambda r: r[:2]):
        yield bits, part, np.fromiter((r[2] for r in own), np.int64).tobytes()


def _compare(radius: int):
    """Rows of (pair, side, tile): side 0 is followed by its partner, side 1; side 2 is a tile to be compared with itself.
    A tile whose partner is empty comes alone."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        left = (None, None)
        for pair, side, packed in rows:
            mine = np.frombuffer(packed, np.int64)
            if side == 0:
                left = (pair, mine)
                continue
            if side == 1 and left[0] != pair:
                continue
            a = mine if side == 2 else left[1]
            both = a if side == 2 else np.concatenate([a, mine])
            shift = 0 if side == 2 else len(a)
            forest = Forest(len(both))
            for p, q in near_pairs(a.view(np.uint64), mine.view(np.uint64), radius):
                forest.link(p, q + shift)
            moved = np.nonzero(forest.root != np.arange(len(both)))[0]
            yield from zip(both[moved].tolist(), both[forest.root[moved]].tolist(), strict=True)

    return run


def link_fingerprints(distinct: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span all links within the radius."""
    counted = distinct.select("fp", F.bit_count("fp").cast("int").alias("bits"))
    split = _tile_counts({r["bits"]: r["n"] for r in counted.groupBy("bits").agg(F.count("*").alias("n")).collect()}, tile)  # 65 rows at most
    if not split:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    keyed = counted.select("bits", _parts_of(F.col("bits"), split, "fp").alias("part"), "fp")
    tiles = cut(map_rows(keyed.repartition("bits", "part").sortWithinPartitions("bits", "part", "fp"), lambda: _pack, "bits int, part int, fps binary"))
    dealt = _pairs_of_tiles(tiles, split, radius, "bits", "fps")
    return map_rows(dealt, lambda: _compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id it is linked to, also by way of others).

    Null, empty and blank texts have the fingerprint zero and are linked like any other. Repeated rows are returned each;
    null doc_ids are returned with the component of their fingerprint. An empty table gives an empty table.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(link_fingerprints(classes, radius, tile)).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of SHINGLE words; of a shorter text, the one of the whole. No words (or null): none."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if len(tokens) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens))] if tokens else [], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = (h ^ w[i : i + n]) * _MIX[i]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """The LONGS longs of the SimHash of a set of hashes: a bit is set if it is set in over half of the set's longs. Of no set: zeros."""
    ones = np.zeros(64 * LONGS, np.int64)
    for at in range(0, len(own), 255):  # counts of a part fit in a byte
        part = own[at : at + 255]
        bits = np.empty((len(part), LONGS), np.uint64)
        for k in range(LONGS):
            x = (part ^ _MIX[k + 1]) * _MIX[k]
            x = (x ^ x >> np.uint64(31)) * _MIX[k + 1]
            bits[:, k] = x ^ x >> np.uint64(29)
        ones += np.unpackbits(bits.view(np.uint8).reshape(len(part), 8 * LONGS), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _set_key(own: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(own.tobytes()))


def _wide_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text_hash, text in rows:
        own = shingles(text)
        yield doc_id, text_hash, _set_key(own), len(own), wide_fingerprint(own).tobytes()


#: A node of a tile: the key of its set, the set's size, the root it is linked to, the fingerprint.
_NODE = np.dtype([("key", "<i8"), ("root", "<i8"), ("n", "<i4"), ("fp", "<u8", LONGS)])


def _pack_wide(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (band, part, key, root, n, fp, packed or null) to one row of each tile, in order of the fingerprints' set bits: the
    nodes, and one after the other their sets."""
    for (band, part), own in groupby(rows, key=lambda r: r[:2]):
        own = list(own)
        tile = np.array([(key, root, n, np.frombuffer(fp, "<u8")) for _, _, key, root, n, fp, _ in own], _NODE)
        order = np.argsort(_set_bits(tile), kind="stable")
        yield band, part, tile[order].tobytes(), b"".join(own[i][6] or b"" for i in order)


def _set_bits(tile: np.ndarray) -> np.ndarray:
    return np.bitwise_count(tile["fp"]).sum(axis=1, dtype=np.int64)


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position in a, in b, bits that differ) of the pairs of nodes within the radii whose sizes do not rule out similarity, in
    pieces. ``same``: a is b, and each pair comes once. Both are sorted by set bits: what differs by more than the radius is skipped."""
    bits_a, bits_b = _set_bits(a), _set_bits(b)
    first_a, first_b = (np.ascontiguousarray(x["fp"][:, 0]) for x in (a, b))
    for i in range(0, len(a), _ROWS):
        rows = slice(i, i + _ROWS)
        start = i if same else int(np.searchsorted(bits_b, bits_a[i] - WIDE_RADIUS))
        stop = int(np.searchsorted(bits_b, bits_a[rows][-1] + WIDE_RADIUS, "right"))
        for j in range(start, stop, _COLS):
            p, q = np.nonzero(np.bitwise_count(first_a[rows, None] ^ first_b[None, j : min(j + _COLS, stop)]) <= FIRST_RADIUS)
            p, q = p + i, q + j
            if same:
                p, q = p[q > p], q[q > p]
            n, m = a["n"][p].astype(np.int64), b["n"][q].astype(np.int64)
            like = (np.minimum(n, m) * DEN >= np.maximum(n, m) * NUM) & (a["root"][p] != b["root"][q])
            p, q = p[like], q[like]
            apart = np.bitwise_count(a["fp"][p] ^ b["fp"][q]).sum(axis=1, dtype=np.int64)
            near = apart <= WIDE_RADIUS
            if near.any():
                yield p[near], q[near], apart[near]


def _nearest(p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs are among the NEAREST of either side."""
    keep = np.zeros(len(p), bool)
    for x in (p, q):
        order = np.lexsort((apart, x))
        new = np.concatenate([[True], x[order][1:] != x[order][:-1]]) if len(x) else np.zeros(0, bool)
        rank = np.arange(len(x)) - np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        keep[order[rank < NEAREST]] = True
    return keep


def _nearest_rows(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple]:
    """Close pairs (a, b) of keys, the NEAREST of each node, and (key, null) for nodes that have others."""
    held: list[tuple] = []
    size, dense = 0, [set(), set()]

    def thinned() -> list[tuple]:
        p, q, apart = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = _nearest(p, q, apart)
        dense[0].update(np.unique(p[~keep]).tolist())
        dense[1].update(np.unique(q[~keep]).tolist())
        return [(p[keep], q[keep], apart[keep])]

    for found in close_pairs(a, b, same):
        held.append(found)
        size += len(found[0])
        if size > 1 << 20:
            held = thinned()
            size = len(held[0][0])
    if held:
        p, q, _ = thinned()[0]
        yield from zip(a["key"][p].tolist(), b["key"][q].tolist(), strict=True)
    for nodes, positions in ((a, dense[0]), (b, dense[1])):
        for i in positions:
            yield int(nodes["key"][i]), None


def _linked_rows(a: np.ndarray, b: np.ndarray, same: bool, sets_a: np.ndarray, sets_b: np.ndarray) -> Iterator[tuple]:
    """Similar pairs (a, b) of keys that join what was not linked before, by roots or by pairs before."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    forest = Forest(len(both))
    order = np.argsort(both["root"], kind="stable")
    again = both["root"][order][1:] == both["root"][order][:-1]
    forest.link(order[1:][again], order[:-1][again])
    ends_a, ends_b = np.cumsum(a["n"], dtype=np.int64), np.cumsum(b["n"], dtype=np.int64)
    for p, q, _ in close_pairs(a, b, same):
        for i in np.unique(p).tolist():
            others = q[p == i]
            others = others[forest.root[others + shift] != forest.root[i]]
            if not len(others):
                continue
            own = sets_a[ends_a[i] - a["n"][i] : ends_a[i]]
            sizes = b["n"][others].astype(np.int64)
            first = np.cumsum(sizes) - sizes
            theirs = sets_b[np.repeat(ends_b[others] - sizes - first, sizes) + np.arange(sizes.sum())]
            common = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs, first)
            for j in others[(NUM + DEN) * common >= NUM * (len(own) + sizes)].tolist():
                if forest.root[i] != forest.root[j + shift]:
                    forest.link(np.array([i]), np.array([j + shift]))
                    yield int(a["key"][i]), int(b["key"][j])


def _compare_wide(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of (pair, side, nodes, sets) as in ``_compare`` to pairs (a, b) of keys: with sets, similar ones that span the links of the
    two tiles; without, close ones."""

    def of_tiles(a: tuple, b: tuple, same: bool) -> Iterator[tuple]:
        if len(a[1]) or len(b[1]):
            return _linked_rows(a[0], b[0], same, a[1], b[1])
        return _nearest_rows(a[0], b[0], same)

    left: tuple = (None, None)
    for pair, side, nodes, sets in rows:
        mine = np.frombuffer(nodes, _NODE), np.frombuffer(sets, np.uint64)
        if side == 0:
            left = (pair, mine)
        elif side == 2:
            yield from of_tiles(mine, mine, True)
        elif left[0] == pair:
            yield from of_tiles(left[1], mine, False)


def _tile_counts(sizes: dict[int, int], tile: int | None) -> dict[int, int]:
    """The tiles of each group. By default tiles grow with the root of the number of nodes, up to ``TILE``: small tables make many
    tasks too, and of large ones each tile is not sent too often. They change the time only."""
    tile = tile or min(TILE, 16 * math.isqrt(sum(sizes.values())) + 1)
    return {group: -(-n // tile) for group, n in sizes.items()}


def _pairs_of_tiles(tiles: DataFrame, counts: dict[int, int], reach: int, group: str, *packed: str) -> DataFrame:
    """(pair, side, packed ...) of every pair of tiles whose groups are no more than ``reach`` apart, for ``_compare``. ``counts``: the
    tiles of each group. The partners of a tile follow from its own place and the counts alone; it is sent to each of its pairs."""
    known = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(n).alias("n")) for g, n in sorted(counts.items())))
    near = F.filter(known, lambda x: F.abs(x["g"] - F.col(group)) <= reach)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), (x["n"] - 1).cast("int")), lambda p: F.struct(x["g"].alias("g"), p.alias("p")))))
    sent = tiles.select(F.struct(F.col(group).alias("g"), F.col("part").alias("p")).alias("mine"), *packed, F.explode(others).alias("other"))
    pair = F.concat_ws(" ", *(f("mine", "other")[k].cast("string") for f in (F.least, F.greatest) for k in ("g", "p")))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    return sent.select(pair.alias("pair"), side.alias("side"), *packed).repartition("pair").sortWithinPartitions("pair", "side")


def _parts_of(group: Column, counts: dict[int, int], key: str) -> Column:
    """The tile of a group that a key is in."""
    return F.pmod(F.xxhash64(key), F.create_map(*(F.lit(x) for kv in counts.items() for x in kv))[group]).cast("int")


def _similar_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for a, b, x, y in rows:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
        if (NUM + DEN) * common >= NUM * (len(x) + len(y)):
            yield a, b


def similar_documents(docs: DataFrame, tile: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (xxhash64 of the text), root (a long that similar texts share, also by way of others).

    Texts without words (null, empty, blank) have equal sets. Null doc_ids and repeated rows are returned each; other columns
    are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prints = cut(map_rows(hashed, lambda: _wide_rows, "doc_id long, text_hash long, key long, n int, fp binary"))
    nodes = prints.groupBy("key").agg(F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"))
    nodes = cut(nodes.withColumn("band", F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(float(np.log(_BAND)))).cast("int")))
    counts = _tile_counts({r["band"]: r["n"] for r in nodes.groupBy("band").agg(F.count("*").alias("n")).collect()}, tile)  # some hundred rows at most
    if not counts:
        return prints.select("doc_id", "text_hash", F.col("key").alias("root"))

    def compared(nodes: DataFrame, counts: dict[int, int]) -> DataFrame:
        keyed = nodes.select("band", _parts_of(F.col("band"), counts, "key").alias("part"), "key", "root", "n", "fp", "packed")
        tiles = map_rows(keyed.repartition("band", "part").sortWithinPartitions("band", "part", "key"), lambda: _pack_wide, "band int, part int, nodes binary, sets binary")
        return cut(map_rows(_pairs_of_tiles(tiles, counts, 1, "band", "nodes", "sets"), lambda: _compare_wide, "a long, b long"))

    pairs = compared(nodes.withColumns({"root": F.col("key"), "packed": F.lit(None).cast("binary")}), counts)
    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select("text_hash")
    texts = hashed.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    sets = cut(map_rows(texts, lambda: lambda rows: ((_set_key(x), x.tobytes()) for x in (shingles(t) for (t,) in rows)), "key long, packed binary").dropDuplicates(["key"]))
    free_shuffles(spark)
    sides = [sets.select(F.col("key").alias(x), F.col("packed").alias(f"packed_{x}")) for x in "ab"]
    sided = pairs.where("b is not null").join(sides[0], "a").join(sides[1], "b").select("a", "b", "packed_a", "packed_b")
    edges = cut(map_rows(sided, lambda: _similar_rows, "a long, b long"))
    free_shuffles(spark)
    rooted = components(edges).select(F.col("id").alias("key"), F.col("component").alias("root"))
    dense = pairs.where("b is null").select(F.col("a").alias("key")).distinct()
    if not dense.isEmpty():
        again = nodes.join(dense, "key", "left_semi").join(rooted, "key", "left").withColumn("root", F.coalesce("root", "key")).join(sets, "key")
        again = cut(again.select("band", "key", "root", "n", "fp", "packed"))
        held = {r["band"]: r["n"] for r in again.groupBy("band").agg(F.sum(F.length("packed")).alias("n")).collect()}
        parts = {band: max(1, min(n // SMALL_TILE, max(MANY_TILES, n // LARGE_TILE))) for band, n in held.items()}
        rooted = components(edges.union(compared(again, parts))).select(F.col("id").alias("key"), F.col("component").alias("root"))
    free_shuffles(spark)
    return prints.join(rooted, "key", "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))


def first_of_each(docs: DataFrame, tile: int | None = None) -> DataFrame:
    """``docs``, of each group of similar texts (``similar_documents``) only the row with the smallest doc_id; rows without one come
    last. Of equal rows, and of equal doc_ids with different similar texts, one stays. All columns are returned."""
    mine, row, kept_id, kept_hash = fresh(docs.columns, "_text_hash", "_row", "_kept_id", "_kept_hash")
    grouped = similar_documents(docs, tile)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x"))
    kept = best.select(F.col("x.doc_id").alias(kept_id), F.col("x.text_hash").alias(kept_hash))
    hashed = docs.withColumn(mine, F.xxhash64("text"))
    # Equal sets of shingles may be of different texts, but a text has one root, so that each of these rows is wanted once.
    wanted = hashed.join(kept, (F.col(mine) == F.col(kept_hash)) & F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
    return wanted.withColumn(row, F.row_number().over(Window.partitionBy(mine, "doc_id").orderBy(F.lit(1)))).where(F.col(row) == 1).drop(mine, row)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
