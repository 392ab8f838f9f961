"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language's dictionary is raw content for zstandard: normalised pieces (lower case, runs of non-letters made one
space) of labelled documents. A whole text is normalised likewise, cut in blocks, and every block compressed with every
dictionary; the language with the smallest sum is chosen, and the choice is rejected when the next one comes close.

The dictionaries are learned from a bounded sample: ``PIECES`` pieces of at most ``PIECE_BYTES`` bytes of each language,
those with the smallest seeded hash of (doc_id, text) among distinct rows, each from a seeded place anywhere in its text. The
``MOST_LANGUAGES`` languages with the most rows are learned. So what is collected and broadcast has a fixed bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table

PIECES, PIECE_BYTES, MOST_LANGUAGES = 96, 1024, 256
LEVEL, MIN_MATCH, BLOCK = 3, 3, 4096
#: A choice is rejected when the next language's size is within this share.
MARGIN = 0.002
SHARPNESS = 16
_SEED = 99
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    return _NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language from (doc_id, text, lang); rows with null text or lang are passed over.

    Ordered by the number of rows, most first; a tie in size goes to the language that stands earlier. Of more than
    ``MOST_LANGUAGES`` languages the rest are not learned.
    """
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    if not counts:
        return {}
    h = F.xxhash64(F.lit(_SEED), "doc_id", "text")
    # Four times as many as wanted, on average, lie under the limit of their language.
    limits = labelled.sparkSession.createDataFrame([(lang, int(min(1.0, 4 * PIECES / n) * (1 << 53))) for lang, n in counts], "lang string, most long")
    chosen = rows.withColumn("h", h).join(F.broadcast(limits), "lang").where(F.shiftrightunsigned("h", 11) <= F.col("most"))
    start = F.pmod(F.xxhash64(F.lit(_SEED + 1), "h"), F.greatest(F.length("text") - PIECE_BYTES + 1, F.lit(1))) + 1
    sample = chosen.select("lang", "h", F.substring("text", start, F.lit(PIECE_BYTES)).alias("piece")).distinct()
    pieces: dict[str, list[tuple[bool, int, bytes]]] = {lang: [] for lang, _ in counts}
    seen = set()
    for r in sample.collect():
        text = normalise(r["piece"])[:PIECE_BYTES]
        if (r["lang"], text) not in seen:
            seen.add((r["lang"], text))
            pieces[r["lang"]].append((len(text) < PIECE_BYTES // 4, r["h"], text))
    return {lang: b"\n".join(t for _, _, t in sorted(found)[:PIECES][::-1]) for lang, found in pieces.items()}


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=BLOCK, dict_size=len(raw), min_match=MIN_MATCH, strategy=zstandard.STRATEGY_BTOPT, write_checksum=False, write_content_size=False, write_dict_id=False
    )
    if len(raw) < 8:  # the library takes no shorter dictionary
        return zstandard.ZstdCompressor(compression_params=params)
    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=d)


class Compressors:
    """The compressors of a worker process, one for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.of = {lang: _compressor(raw) for lang, raw in dictionaries.items()}

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); ``und`` with zeros for null, for a text without a letter, or where nothing was learned."""
        if text is None or not self.of or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = normalise(text)
        sizes = {lang: sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for lang, c in self.of.items()}
        ordered = sorted(sizes.items(), key=lambda x: x[1])
        best, least = ordered[0]
        margin = 1 - least / ordered[1][1] if len(ordered) > 1 else 1.0
        return best, 1 / sum((least / s) ** SHARPNESS for _, s in ordered), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score (0 to 1), margin and rejected to ``keep``'s columns (default: doc_id) of every row.

    Rejected: ``und``, or a margin under ``margin``. ``text`` is the only column read for the prediction. Repeated rows are
    predicted each. Kept columns must not have the names of those added (ValueError).
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := {"lang_pred", "score", "margin", "rejected"} & {x.lower() for x in keep}:
        raise ValueError(f"columns {sorted(clash)} are added here")
    broadcast = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    ddl = ", ".join(f"{n} {'long' if t == 'bigint' else t}" for n, t in rows.dtypes[:-1]) + ", lang_pred string, score double, margin double, rejected boolean"

    def make():
        compressors = Compressors(broadcast.value)

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for *kept, text in rows:
                lang, score, gap = compressors.classify(text)
                yield *kept, lang, score, gap, lang == "und" or gap < margin

        return run

    return map_rows(rows, make, ddl)


def is_held_out(doc_id: Column) -> Column:
    """Of documents no one may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    dictionaries = learn(docs.where(~is_held_out(F.col("doc_id"))))
    found = identify(docs, dictionaries)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")
