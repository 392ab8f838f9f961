"""Byte-level BPE by dynamic programming over prefixes, without replaying merges.

For every prefix of a word there is exactly one token that can stand last in its encoding: a token that ends there and
that is compatible with the last token of what is before it. An automaton over the vocabulary yields the tokens ending at
each position, a memoised pair test decides compatibility, and following the last tokens back from the end of the word
gives the ids that merging would have given. A word of any length takes time in proportion to its length, where replayed
merges would take its square.

The tokenizer file is read on the driver and broadcast: its size is checked against ``MOST_FILE_BYTES``.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read_table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MOST_FILE_BYTES = 64 << 20
#: Entries of the two caches of a worker process; a full cache is emptied, which costs time only.
MOST_WORDS, MOST_PAIRS, LONGEST_CACHED = 200_000, 400_000, 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else 256 and up, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(printable))
    return [out[b] for b in range(256)]


class PrefixBPE:
    """A tokenizer from the JSON of a byte-level BPE with the usual pre-tokenising pattern and no prefix space."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE with plain merges is supported")
        of_symbol = {s: b for b, s in enumerate(byte_symbols())}
        as_bytes = {t: bytes(of_symbol[c] for c in t) for t in model["vocab"]}
        self.bytes_of: dict[int, bytes] = {i: as_bytes[t] for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_bits = max(self.bytes_of).bit_length()
        vocab = model["vocab"]
        #: Of each pair of tokens that merges: the merge's rank. Of each token: its rank (bytes: -1) and its two halves.
        self.pairs: dict[int, int] = {}
        self.rank = dict.fromkeys(self.bytes_of, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            if made in self.halves or self.rank[a] >= r or self.rank[b] >= r:
                raise ValueError("a token with two merges, or a merge of tokens that come later")
            self.pairs[a << self.id_bits | b] = self.rank[made] = r
            self.halves[made] = (a, b)
        self.automaton = ahocorasick.Automaton()
        reachable: set[int] = set()
        for i in sorted(vocab.values(), key=self.rank.__getitem__):
            halves = self.halves.get(i)
            if halves is None and len(self.bytes_of[i]) > 1:
                continue
            if halves is None or {*halves} <= reachable and self._stands(*halves, self.rank[i]):
                reachable.add(i)
                self.automaton.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.automaton.make_automaton()
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self._pair: dict[int, bool] = {}
        self._word: dict[str, bytes] = {}

    def _stands(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Does merging leave the border between two tokens alone? Undoes their latest merges along the border; a pair that
        meets there and merges before the merge just undone would have crossed it. Of equal ranks the left goes first."""
        rank, halves = self.rank, self.halves
        while True:
            if self.pairs.get(left << self.id_bits | right, limit) < limit:
                return False
            if rank[left] > rank[right]:
                limit, left = rank[left], halves[left][1]
            elif right in halves:
                limit, right = rank[right] + 1, halves[right][0]
            else:
                return True

    def _encode_word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass").decode("latin-1")
        n = len(raw)
        last, pair, bits = [-1] * (n + 1), self._pair, self.id_bits
        for end, (token, length) in self.automaton.iter(raw):
            end += 1
            if last[end] < 0:
                start = end - length
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    key = before << bits | token
                    ok = pair.get(key)
                    if ok is None:
                        if len(pair) >= MOST_PAIRS:
                            pair.clear()
                        ok = pair[key] = self._stands(before, token)
                    if not ok:
                        continue
                last[end] = token
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        out.reverse()
        ids = array("I", out).tobytes()
        if n <= LONGEST_CACHED:
            if len(self._word) >= MOST_WORDS:
                self._word.clear()
            self._word[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Added tokens in the text are found as such."""
        parts = self.specials.split(text) if self.specials else [text]
        out, known, make = [], self._word, self._encode_word
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out += [known.get(w) or make(w) for w in self.words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[i] for i in array("I", ids)]).decode("utf-8", "replace")


_LOADED: dict[str, PrefixBPE] = {}


def _load(raw: bytes) -> PrefixBPE:
    """The tokenizer of a worker process, kept between its tasks."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PrefixBPE(raw)
    return _LOADED[key]


def _file(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        raw = f.read(MOST_FILE_BYTES + 1)
    if len(raw) > MOST_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MOST_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids array<int>) of whole texts. Null text: no ids. Repeated rows are encoded each; other columns are ignored."""
    raw = _file(docs.sparkSession, tokenizer_path)

    def make():
        bpe = _load(raw.value)
        return lambda rows: ((doc_id, array("I", bpe.encode(text or "")).tolist()) for doc_id, text in rows)

    return map_rows(docs.select(docs["doc_id"].cast("long"), docs["text"]), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids: empty text. Bytes that are no UTF-8 become U+FFFD."""
    raw = _file(encoded.sparkSession, tokenizer_path)

    def make():
        bpe = _load(raw.value)
        return lambda rows: ((doc_id, bpe.decode(array("I", ids or []).tobytes())) for doc_id, ids in rows)

    return map_rows(encoded.select(encoded["doc_id"].cast("long"), encoded["ids"]), make, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """Encode whole texts, decode the ids, and return the digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no tokens and the digest of no bytes. One output row for each input row.
    """
    raw = _file(docs.sparkSession, tokenizer_path)

    def make():
        bpe, sha = _load(raw.value), hashlib.sha256

        def run(rows: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in rows:
                ids = bpe.encode(text or "")
                yield doc_id, len(ids) // 4, sha(ids).hexdigest(), sha(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

        return run

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
