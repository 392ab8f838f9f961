"""Lempel-Ziv phrase fingerprints.

A text is parsed, code point by code point, into the phrases a Lempel-Ziv dictionary coder would add: each is the shortest
piece that is not yet in the dictionary. Two texts that compress well together share many phrases. The phrase set is
hashed and the ``SIZE`` smallest hashes are the signature; the share of common hashes among the smallest of both estimates
the Jaccard likeness of the sets, and is exact while both sets together have no more than ``SIZE`` phrases.

The query compares every document with its edited text and with its successor by doc_id. Documents go once through a
shuffle, dealt by ranges of doc_id and sorted; each range also gets the first document of the next one, so that the
successor is always the next row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table

SIZE = 128
_MASK, _STEP = (1 << 61) - 1, 1_000_003


def parse(text: str, phrases: set[int], at: int = 0) -> int:
    """Add the phrases of ``text`` to ``phrases``, each as the rolling hash of its code points. ``at``: the hash of the phrase
    that was left open before; returns that of the phrase left open now (0: none). An open phrase is in the set already."""
    add = phrases.add
    for c in text:
        longer = (at * _STEP + ord(c) + 1) & _MASK
        if longer in phrases:
            at = longer
        else:
            add(longer)
            at = 0
    return at


def signature(phrases: set[int], size: int = SIZE) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases, in order, each once."""
    x = np.fromiter(phrases, np.uint64, len(phrases))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return np.unique((x >> np.uint64(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of the smallest hashes of both that both have. Two empty signatures: 1."""
    both = np.union1d(a, b)[:size]
    if not len(both):
        return 1.0
    return float((np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)).sum() / len(both))


def shown(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint(text: str | None, size: int = SIZE) -> str:
    """The signature in hexadecimal, eight digits a hash. Null: as empty, no digits."""
    found: set[int] = set()
    parse(text or "", found)
    return shown(signature(found, size))


def fingerprint_documents(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, fingerprint) of every row's whole text; equal texts have equal fingerprints."""
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), lambda: lambda rows: ((d, fingerprint(t, size)) for d, t in rows), "doc_id long, fingerprint string")


def _with_next(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, own in groupby(rows, key=lambda r: r[0]):
        held = None
        for _, last, doc_id, text in own:
            text = text or ""
            if held is not None:
                before, head, n, known, at, sig = held
                tail = text[: n // 2]
                parse(tail, known, at)
                edited, mine = signature(known), None
            if not last:
                half = len(text) - len(text) // 2
                found: set[int] = set()
                at_half = parse(text[:half], found)
                known_half = found.copy()
                parse(text[half:], found, at_half)
                mine = signature(found)
            elif held is not None:
                whole: set[int] = set()
                parse(text, whole)
                mine = signature(whole)
            if held is not None:
                sha = hashlib.sha256((head + tail).encode("utf-8", "surrogatepass")).hexdigest()
                yield before, n, sha, shown(sig), shown(edited), likeness(sig, edited), likeness(sig, mine)
            held = None if last else (doc_id, text[:half], len(text), known_half, at_half, mine)


def _below(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are x or less: among every m-th of them first, then among the m that follow, m being the
    root of their number."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts)) + 1
    count = lambda values: F.size(F.filter(values, lambda c: c <= x))
    literal = lambda values: F.from_json(F.lit(str(list(values))), "array<bigint>")  # noqa: E731  # one literal, however many
    first = count(literal(cuts[::m])) - 1
    return F.when(first < 0, 0).otherwise(first * m + count(F.slice(literal(cuts), first * m + 1, F.lit(m))))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row, as op2 has them.

    Null texts count as empty. Rows are ordered by doc_id (null first), equal ids by the hash of the text; a single row is its
    own successor. An empty table gives an empty table. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("place"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8 * parts
    cuts = rows.agg(F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"]
    rows = rows.withColumn("range", _below(F.col("place"), sorted(set(cuts or []))).cast("int"))
    firsts = {r["range"]: r["p"] for r in rows.groupBy("range").agg(F.min("place").alias("p")).collect()}  # a row for each range
    order = sorted(firsts)
    before = dict(zip(order[1:] + order[:1], order, strict=True))
    tied = F.xxhash64("text")
    heads = docs.sparkSession.createDataFrame([(k, p, before[k]) for k, p in firsts.items()], "range int, place long, to int")
    first_rows = rows.join(F.broadcast(heads), ["range", "place"]).groupBy("to", "place").agg(F.min_by(F.struct("doc_id", "text"), tied).alias("r"))
    extra = first_rows.select(F.col("to").alias("range"), F.lit(True).alias("last"), "r.doc_id", "r.text", "place")
    both = rows.select("range", F.lit(False).alias("last"), "doc_id", "text", "place").union(extra).withColumn("tied", tied)
    dealt = both.repartition(parts, "range").sortWithinPartitions("range", "last", "place", "tied").select("range", "last", "doc_id", "text")
    return map_rows(dealt, lambda: _with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))
