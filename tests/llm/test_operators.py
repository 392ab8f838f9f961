"""Every operator against brute force, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chunkloom.llm import bpe, components, language, mixing, phrases, sharding, simhash, substrings, toolcalls, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tur", "san", "bel") for b in ("r", "st", "do", "fi", "gan", "mu", "pel", "to")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, **extra):
    """Documents; ``extra`` columns have names that operators use themselves."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


CLASHES = dict(size=1, shard="x", slot=None, fp=3, component_id="c", fingerprint=0, root=1, h=2, d="d", pos=1, salt=0, place=9, range="r", last=True, tied=5, score=1.0, margin=2.0, rejected=False, tokens=3, posterior="p", rate=1, copies=2, bits=3, part=4)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    long = prose(rng, 20_000)
    rows = [
        (1, prose(rng, 80), "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \n\t ", "de", None),
        (5, long, "en", "b"),
        (6, long, "en", "b"),
        (6, long, "en", "b"),
        (None, prose(rng, 60), "en", "a"),
        (None, None, None, None),
        (7, "12 34 !!", "de", "a"),
        (8, "\u0000 naïve 日本語 🎉", "fr", "c"),
        (9, "a" * 30_000, "en", "c"),
    ]
    return frame(spark, rows, **CLASHES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rng = random.Random(1)
    for text in (None, "", " ", "One", "One two", "A b C", "Ünï\u00a0x y\u2003z w", prose(rng, 400).upper(), prose(rng, 30) + "\x0b\x0c\r\n" + prose(rng, 3)):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_fingerprints_are_all_linked(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) << np.uint64(1)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))) for b in base for _ in range(3)]
    values = np.unique(np.concatenate([base, np.array(flips, np.uint64), [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)]]))
    signed = values.view(np.int64).tolist()
    near = [(signed[i], signed[int(j)]) for i in range(len(values)) for j in np.nonzero(np.bitwise_count(values[i] ^ values) <= 3)[0] if j > i]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tile in (8, 1 << 16):
        edges = [(r["a"], r["b"]) for r in simhash.link_fingerprints(df, tile=tile).collect()]
        assert brute_components(signed, edges) == brute_components(signed, near)
        assert len(edges) <= sum(1 for _ in near) * 2


def test_near_pairs_by_parts(monkeypatch):
    rng = np.random.default_rng(20)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)
    y = np.concatenate([x[:200] ^ np.uint64(1 << 40 | 1 << 2 | 1 << 63), x[200:] ^ np.uint64(15), x[:50], [np.uint64(0)]])
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ y[None]) <= 3))}
    assert len(want) >= 250
    for limit in (0, 1 << 60):
        monkeypatch.setattr(simhash, "_QUARTERS", limit)
        assert {(int(i), int(j)) for p, q in simhash.near_pairs(x, y, 3) for i, j in zip(p, q)} == want


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, prose(rng, 200), "en", "s") for i in range(20)]
    rows += [(100 + i, rows[i][1].replace("kar", "kar", 1) + " extra", "en", "s") for i in range(5)] + [(200, rows[3][1], "en", "s")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t) for i, t, _, _ in rows}
    want = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 12
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {2}
    assert [r["component_id"] for r in rows if r["doc_id"] in (5, 6)] == [5, 5, 5]
    assert simhash.near_duplicates(empty).collect() == []


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (2000, 2001), (2000, 2001)] + [(3000, 3000 + i) for i in range(1, 400)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute_components(ids, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).collect() == []


# 2


def brute_phrases(text):
    found, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in found:
            found.add(text[start:end])
            start = end
    return found


def test_phrases_are_those_of_the_parse():
    rng = random.Random(6)
    for text in ("", "a", "aaaaaa", prose(rng, 300), "日本日本日本語", "\u0000\u0000\u0001"):
        hashes: set = set()
        phrases.parse(text, hashes)
        assert len(hashes) == len(brute_phrases(text))
        cut = len(text) // 2
        again: set = set()
        phrases.parse(text[cut:], again, phrases.parse(text[:cut], again))
        assert again == hashes


def test_likeness():
    rng = random.Random(7)
    a, b = prose(rng, 400), prose(rng, 400)
    mixed = a[: len(a) // 2] + b[: len(b) // 2]

    def sig(t, size=phrases.SIZE):
        found: set = set()
        phrases.parse(t, found)
        return phrases.signature(found, size)

    exact = lambda x, y: len(brute_phrases(x) & brute_phrases(y)) / len(brute_phrases(x) | brute_phrases(y))
    assert phrases.likeness(sig(a), sig(a)) == 1 and phrases.likeness(sig(""), sig("")) == 1 and phrases.likeness(sig(""), sig(a)) == 0
    assert phrases.likeness(sig(a, 10**6), sig(mixed, 10**6), 10**6) == pytest.approx(exact(a, mixed), abs=1e-3)
    assert abs(phrases.likeness(sig(a), sig(mixed)) - exact(a, mixed)) < 0.2
    assert phrases.likeness(sig(a), sig(mixed)) > phrases.likeness(sig(a), sig(b))


@pytest.mark.parametrize("n", [0, 1, 2, 9, 50])
def test_ranges(spark, n):
    rng = random.Random(n)
    cuts = sorted(rng.sample(range(-60, 60), n))
    got = spark.range(-70, 70).select("id", phrases._below(F.col("id"), cuts).alias("k")).collect()
    assert all(r["k"] == sum(c <= r["id"] for c in cuts) for r in got)


def test_compare_with_next(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i * 7 % 101 - 50, prose(rng, rng.choice([0, 1, 5, 60])), "en", "s") for i in range(101)]
    got = {r["doc_id"]: r for r in phrases.compare_with_next(frame(spark, rows)).collect()}
    ordered = sorted(rows)
    for k, (i, t, _, _) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (phrases.fingerprint(t), phrases.fingerprint(edited))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    rows = phrases.compare_with_next(odd).collect()
    assert len(rows) == 12 and {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3)} == {""}
    alone = phrases.compare_with_next(frame(spark, [(1, "abcdef", "en", "s")])).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and alone[0]["near_next"] == 1
    assert phrases.compare_with_next(empty).collect() == []
    prints = phrases.fingerprint_documents(odd).collect()
    assert len(prints) == 12 and len({r["fingerprint"] for r in prints if r["doc_id"] in (5, 6)}) == 1


# 3


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_words():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
        got = substrings.common_words(a, b)
        assert len(got) == brute_lcs(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p < r and q < s for (p, q), (r, s) in zip(got, got[1:]))


def test_chains_are_best():
    rng = random.Random(10)
    for _ in range(150):
        anchors = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(2, 9))})

        def score(chain):
            return substrings.GAIN * len(chain) - sum(substrings.GAP * (q[0] - p[0] + q[1] - p[1]) / 2 for p, q in zip(chain, chain[1:]))

        best = 0.0
        for mask in range(1, 1 << len(anchors)):
            chain = [a for i, a in enumerate(anchors) if mask >> i & 1]
            if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:])):
                best = max(best, score(chain))
        got = [[x[:2] for x in c] for c in substrings.chains([(*x, 0, 1) for x in anchors])]
        assert all(p[0] < q[0] and p[1] < q[1] for c in got for p, q in zip(c, c[1:]))
        if best > substrings.GAIN:
            assert max(map(score, got)) == pytest.approx(best)


def test_common_words_by_the_shorter_ways(monkeypatch):
    """Texts that lie in each other or begin alike are aligned as by all rows, with fewer or none of these; runs without gaps are not gone through."""
    rng, lengths, plain = np.random.default_rng(5), [], substrings._rows_back
    monkeypatch.setattr(substrings, "_rows_back", lambda a, b: lengths.append(len(a)) or plain(a, b))
    for n in range(400):
        a = rng.integers(0, 2 + n % 9, rng.integers(1, 25)).tolist()
        b = rng.integers(0, 2 + n % 9, rng.integers(1, 25)).tolist()
        for x, y in ((a, b), (b, a), (a, a[::2] or a), (a[3:] or a, b[:5] + a), (a + b, a + b[::-1])):
            assert substrings._subsequence(x, y) == plain(x, y)
    lengths.clear()
    words = list(range(60))
    assert substrings._subsequence(words, [7, *words, 8]) == [(i, i + 1) for i in words] and not lengths
    assert len(substrings._subsequence(words + [70, 71], words + [71, 70, 72])) == 61 and lengths == [2]
    reads = []

    class Counted(list):
        def __getitem__(self, i):
            reads.append(i)
            return super().__getitem__(i)

    assert list(substrings._runs(Counted((i, i + 3) for i in range(1000)), 0, 1000, 2.0)) == [(0, 999)] and len(reads) < 10


def test_texts_are_dealt_once_for_the_rest(spark):
    texts = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    rest = spark.createDataFrame([(1, 2, 0, 1, 1)], "doc long, key long, pos int, open int, parts int")
    plan = substrings._rest_links(texts, rest, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 2


def test_passages(spark, odd, empty):
    rng = random.Random(11)
    shared, other = prose(rng, 70).split(), prose(rng, 200).split()
    fuzzy = [w if i % 13 else "changed" for i, w in enumerate(shared)]
    body = lambda n: prose(rng, n).split()
    texts = {
        1: body(100) + shared + body(30),
        2: body(300),
        3: shared + body(50),
        4: body(20) + fuzzy + body(90),
        5: other,
        6: body(40) + other[:45] + body(40),
        7: other,
        8: body(5000) + shared + body(100) + other[60:160],
    }
    docs = frame(spark, [(i, " ".join(w), "en", "s") for i, w in texts.items()])
    found = substrings.passages(docs).collect()
    hit = {i: set() for i in texts}
    for r in found:
        assert r["ref_doc_id"] < r["doc_id"]
        hit[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    where = {3: range(0, 70), 4: range(20, 90), 7: range(0, 200), 8: [*range(5000, 5070), *range(5170, 5270)]}
    for i in texts:
        want = set(where.get(i, ()))
        assert len(want - hit[i]) <= 2 and len(hit[i] - want) <= 4, i
    cleaned = {r["doc_id"]: r for r in substrings.remove_passages(docs, substrings.passages(docs)).collect()}
    assert set(cleaned) == {1, 2, 3, 4, 5, 6, 8}
    assert all(cleaned[i]["text"] == " ".join(texts[i]) for i in (1, 2, 5, 6))
    assert len(cleaned[8]["text"].split()) == len(texts[8]) - 170 and cleaned[8]["n_chars"] == len(cleaned[8]["text"])
    got = substrings.passages(odd).collect()
    assert {(r["doc_id"], r["ref_doc_id"], r["start_word"], r["end_word"]) for r in got} == {(6, 5, 0, 20_000)}
    left = substrings.remove_passages(odd, substrings.passages(odd))
    assert left.columns == odd.columns and left.count() == 10
    assert substrings.passages(empty).collect() == [] and substrings.remove_passages(empty, substrings.passages(empty)).collect() == []


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_passage_held_more_often_than_before(spark, monkeypatch, chunk):
    """All copies of a passage in a later document are found, though the earlier one has it once; read together or apart."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(41)
    shared = prose(rng, 70)
    texts = {1: [prose(rng, 40), shared], 2: [prose(rng, 30), shared, prose(rng, 200), shared, prose(rng, 20)], 3: [shared, prose(rng, 90), shared, prose(rng, 90), shared]}
    docs = frame(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()])
    hit = {i: set() for i in texts}
    for r in substrings.passages(docs).collect():
        assert r["ref_doc_id"] < r["doc_id"]
        hit[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    where = {1: set(), 2: {*range(30, 100), *range(300, 370)}, 3: {*range(70), *range(160, 230), *range(320, 390)}}
    for i in texts:
        assert len(where[i] - hit[i]) <= 2 and len(hit[i] - where[i]) <= 4, i


@pytest.mark.parametrize("chunk", [1 << 20, 512])
def test_hot_passages(spark, monkeypatch, chunk):
    """A passage that most documents hold is found in all but the first."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(12)
    shared = prose(rng, 80)
    docs = frame(spark, [(i, prose(rng, 60) + " " + shared + " " + prose(rng, 20), "en", "s") for i in range(120)])
    found = substrings.passages(docs).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 120))
    assert len(found) <= 4 * 120


def test_seeds_of_texts_together_are_those_of_each():
    rng = random.Random(42)
    texts = [substrings.word_hashes(prose(rng, n)) for n in (0, 1, 3, 4, 35, 36, 37, 49, 50, 400, 0, 36)]
    key, of, pos = substrings.seeds(np.concatenate(texts), np.array([len(t) for t in texts]))
    for i, t in enumerate(texts):
        alone, _, at = substrings.seeds(t, np.array([len(t)]))
        short = lambda k, p: {(int(x), int(y)) for x, y in zip(k, p) if not x & 1}
        assert short(key[of == i], pos[of == i]) == short(alone, at)
        long = pos[(of == i) & (key & 1 == 1)]
        assert all((long[None] >= s).any() and ((long >= s) & (long + substrings.LONG <= s + 49)).any() for s in range(len(t) - 48))
    assert [len(x) for x in substrings.seeds(np.zeros(0, np.uint32), np.zeros(1, np.int64))] == [0, 0, 0]


def test_pack():
    rng = np.random.default_rng(43)
    columns = [rng.integers(-(1 << 62), 1 << 62, 50), np.full(50, -7), rng.integers(0, 70_000, 50), np.array([-(1 << 63), (1 << 63) - 1] * 25), rng.integers(0, 1 << 48, 50).astype(np.uint64)]
    got = substrings.unpack(substrings.pack(*columns), 5)
    assert all((x.astype(np.int64) == y).all() for x, y in zip(columns, got))


def test_buckets_of_many_tasks(spark):
    """Each task writes a blob for each bucket: no more buckets than tasks where these are many, several a task where they are few."""
    docs = frame(spark, [(1, "a b c", "en", "s")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks, buckets in ((1, 4), (6, 24), (32, 64), (211, 211)):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            assert substrings._buckets(docs) == buckets
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_partners_are_those_of_brute_force():
    rng = random.Random(44)
    for _ in range(50):
        rows = sorted({(rng.randrange(4), rng.randrange(5), rng.randrange(9)) for _ in range(rng.randrange(40))})
        key, d, pos = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        for i, p in enumerate(substrings.partners(key, d).tolist()):
            k, doc, _ = rows[i]
            lower = [x for x in rows if x[0] == k and x[1] < doc]
            same = [x for x in rows if x[:2] == (k, doc)]
            if lower:
                those = [x for x in lower if x[1] == lower[-1][1]]
                assert rows[p] == those[min(same.index(rows[i]), len(those) - 1)]
            else:
                assert p == -1


def edited(rng, words, share, every):
    """The words with one in ``every`` (or a random share) changed, left out or doubled."""
    out = []
    for i, w in enumerate(words):
        if (i % every == every - 1) if every else rng.random() < share:
            out += rng.choice([[rng.choice(WORDS) + "x"], [], [w, "added"]]) if not every else [f"new{rng.randrange(10**6)}"]
        else:
            out.append(w)
    return out


@pytest.mark.parametrize(("n", "share", "every"), [(60, 0, 8), (60, 0, 6), (100, 0, 5), (60, 0.1, 0), (100, 0.15, 0)])
def test_fuzzy_recall(spark, n, share, every):
    """Of edited passages at least 0.9 are found whole; unrelated words beside them are not taken for them."""
    rng = random.Random(n + every)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    body = lambda k: [rng.choice(words) for _ in range(k)]
    rows, where = [], {}
    for i in range(0, 160, 2):
        passage = body(n)
        copy = edited(rng, passage, share, every)
        before = body(rng.randrange(10, 90))
        rows += [(i, " ".join(body(40) + passage + body(70)), "en", "s"), (i + 1, " ".join(before + copy + body(50)), "en", "s")]
        where[i + 1] = range(len(before), len(before) + len(copy))
    hit: dict[int, set] = {i: set() for i in where}
    for r in substrings.passages(frame(spark, rows)).collect():
        assert r["ref_doc_id"] == r["doc_id"] - 1
        hit[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert sum(len(hit[i] & set(w)) >= 0.9 * len(w) for i, w in where.items()) >= 0.9 * len(where)
    assert all(len(hit[i] - set(w)) <= 6 for i, w in where.items())


def test_every_exact_run_is_found(spark):
    """Against all runs of 50 words: repeats inside documents, lines held singly by later documents, runs of many documents."""
    rng = random.Random(45)
    words = [f"{a}{b}" for a in WORDS for b in WORDS[:9]]
    body = lambda k: [rng.choice(words) for _ in range(k)]
    lines = [body(k) for k in (30, 30, 20, 20, 20, 15, 15, 15, 15)]
    blocks = [lines[0] + lines[1], lines[2] + lines[3] + lines[4], lines[5] + lines[6] + lines[7] + lines[8], body(50), body(51), body(300)]
    texts = {0: body(30) + [w for b in blocks for w in [*b, *body(9)]]}
    for i in range(1, 60):
        parts = [body(rng.randrange(60))]
        for _ in range(rng.randrange(1, 5)):
            parts += [rng.choice(lines if i < 40 and i % 3 else blocks), body(rng.randrange(1, 40))]
        texts[i] = [w for p in parts for w in p]
    runs: dict[tuple, int] = {}
    for i, t in texts.items():
        for k in range(len(t) - 49):
            runs.setdefault(tuple(t[k : k + 50]), i)
    want = {i: {w for k in range(len(t) - 49) if runs[tuple(t[k : k + 50])] < i for w in range(k, k + 50)} for i, t in texts.items()}
    hit: dict[int, set] = {i: set() for i in texts}
    for r in substrings.passages(frame(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()])).collect():
        hit[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert sum(map(len, want.values())) > 2000
    for i in texts:
        # A word beside a passage may happen to stand beside it in another earlier document too.
        assert all(w - 1 in hit[i] or w + 1 in hit[i] for w in want[i] - hit[i]) and len(want[i] - hit[i]) <= 2, i


def test_matched_words_are_those_of_common_words():
    rng = np.random.default_rng(54)
    x, y = rng.integers(0, 9, (40, 64)).astype(np.uint16), rng.integers(0, 12, (40, 64)).astype(np.uint16)
    x[:9], there = y[:9], rng.integers(0, 65, 40)
    got = substrings._matched(x, y, there)
    for a, b, n, counts in zip(x.tolist(), y.tolist(), there.tolist(), got.tolist()):
        assert counts == [len(substrings.common_words(a[: t + 1], b[:n])) for t in range(64)]


def test_seeds_are_the_smallest_of_their_windows():
    rng = np.random.default_rng(55)
    for n, width in ((1, 1), (14, 14), (200, 14), (60, 5)):
        h = rng.integers(0, 50, n).astype(np.uint64)
        for of, plain in ((np.minimum, min), (np.maximum, max)):
            assert substrings._sliding(of, h, width).tolist() == [plain(h[i : i + width].tolist()) for i in range(n - width + 1)]


def contexts_of(changes):
    """One key in one document each, at the start of texts of 64 words; ``changes`` are the places behind the seed whose word is the document's own."""
    n = len(changes)
    context = np.zeros((n, 2 * substrings.MARGIN), np.uint16)
    context[:, substrings.MARGIN : substrings.MARGIN + 60] = np.arange(1, 61)
    for i, (own, places) in enumerate(changes):
        context[i, [substrings.MARGIN + p for p in places]] = [own * 60 + 100 + p for p in places]
    return np.full(n, 8), np.arange(n), np.ones(n, np.int64), context, np.zeros(n, np.int64), np.full(n, 60)


def test_pairs_too_unlike_for_a_passage_are_not_linked():
    """Two texts alike in two of three words hold together loosely, but have no 50 words of which 0.8 are alike."""
    loosely, closely = [p for p in range(60) if p % 6 > 3], [p for p in range(60) if p % 10 == 5]
    later, earlier = substrings.candidates(*contexts_of([(0, []), (1, loosely), (2, closely)]))
    assert list(zip(later.tolist(), earlier.tolist())) == [(2, 0)]


def test_copies_around_a_seed_are_compared_once(monkeypatch):
    """Of 20 copies of one text and 20 of another all pairs are linked, but their words are compared once each way."""
    compared, plain = [], substrings._long_enough
    monkeypatch.setattr(substrings, "_long_enough", lambda *x: compared.append(len(x[-1])) or plain(*x))
    later, earlier = substrings.candidates(*contexts_of([(i % 2, [5, 15] if i % 2 else [25]) for i in range(40)]))
    assert {(i, j) for i in range(40) for j in range(i) if (i + j) % 2} <= set(zip(later.tolist(), earlier.tolist()))
    assert 0 < sum(compared) <= 4


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_passage_whose_pieces_later_documents_hold(spark, monkeypatch, chunk):
    """A passage is found though each of its seeds stands in a nearer document that has too short a piece of it."""
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(47)
    words = [f"{a}{b}" for a in WORDS for b in WORDS[:9]]
    body = lambda k: [rng.choice(words) for _ in range(k)]
    shared = body(60)
    texts = {1: body(40) + shared + body(30)} | {i: body(25) + shared[a : a + 45] + body(25) for i, a in ((2, 0), (3, 8), (4, 15))}
    texts[5] = body(35) + shared + body(45)
    docs = frame(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()])
    found = substrings.passages(docs).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in found} == {(5, 1)}
    assert set(range(35, 95)) <= {w for r in found for w in range(r["start_word"], r["end_word"])}


def test_passage_with_one_seed_outside_a_nearer_piece(spark):
    """The end of a passage is found though its one seed there stands in one earlier document only, and a nearer one holds the beginning."""
    rng = random.Random(52)
    words = [f"{a}{b}" for a in WORDS for b in WORDS]
    body = lambda k: [rng.choice(words) for _ in range(k)]

    def seeds_of(t):
        return set(substrings.seeds(substrings.word_hashes(" ".join(t)), np.array([len(t)]))[0].tolist())

    # An older copy with edits, that has one seed in common with the end of the passage, which the nearer document lacks.
    while True:
        shared = body(80)
        older = [f"old{i}" if i in (59, 64, 69, 74) else w for i, w in enumerate(shared)]
        if len(seeds_of(shared[55:]) & seeds_of(older[55:])) == 1 and not seeds_of(shared[52:59]) & seeds_of(older[52:59]):
            break
    texts = {1: body(30) + older + body(30), 2: body(25) + shared[:55] + body(25), 3: body(35) + shared + body(40)}
    hit: set[int] = set()
    for r in substrings.passages(frame(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()])).collect():
        if r["doc_id"] == 3:
            hit.update(range(r["start_word"], r["end_word"]))
    assert set(range(35, 115)) <= hit <= set(range(34, 116))


def test_no_link_is_lost(spark):
    """Against alignments at every seed of every two documents: edited copies of blocks whose lines many documents hold."""
    rng = random.Random(48)
    words = [f"{a}{b}" for a in WORDS for b in WORDS[:9]]
    body = lambda k: [rng.choice(words) for _ in range(k)]
    lines = [body(rng.randrange(8, 30)) for _ in range(12)]
    blocks = [[w for k in rng.sample(range(12), 4) for w in lines[k]] for _ in range(6)]
    texts = {}
    for i in range(70):
        texts[i] = body(rng.randrange(40))
        for _ in range(rng.randrange(1, 4)):
            texts[i] += edited(rng, rng.choice(blocks if rng.random() < 0.3 else lines), 0.08, 0) + body(rng.randrange(30))
    texts[70], texts[71] = ["the"] * 300 + body(30), body(30) + ["the"] * 200 + body(20)
    at = {}
    for i, t in texts.items():
        hashes = substrings.word_hashes(" ".join(t))
        key, _, pos = substrings.seeds(hashes, np.array([len(t)]))
        at[i] = hashes, list(zip(key.tolist(), pos.tolist()))
    want: dict[int, set] = {i: set() for i in texts}
    for i, (a, mine) in at.items():
        for j in range(i):
            b, theirs = at[j]
            places: dict[int, list[int]] = {}
            for k, q in theirs:
                places.setdefault(k, []).append(q)
            for k, p in mine:
                for q in places.get(k, ()) if i < 70 else ():
                    x, y = max(0, p - substrings.MARGIN), max(0, q - substrings.MARGIN)
                    end = substrings.LONG + substrings.MARGIN
                    for s, e, *_ in substrings.align(a[x : p + end], b[y : q + end], [(p - x, q - y)]):
                        want[i].update(range(x + s, x + e))
    want[71] = set(range(30, 230))
    hit: dict[int, set] = {i: set() for i in texts}
    for r in substrings.passages(frame(spark, [(i, " ".join(t), "en", "s") for i, t in texts.items()])).collect():
        hit[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert sum(map(len, want.values())) > 1000
    # No stretch that holds a seed is left out; single words at the border of a passage depend on whom it is aligned with.
    for i in texts:
        left = sorted(want[i] - hit[i])
        runs = np.split(np.array(left), np.nonzero(np.diff(left) > 1)[0] + 1) if left else []
        assert all(len(x) < 8 for x in runs), (i, left)


def test_remove_passages_with_columns_of_its_own_names(spark):
    rng = random.Random(46)
    shared = prose(rng, 60)
    rows = [(1, shared, "en", "s"), (2, prose(rng, 20) + " " + shared, "en", "s"), (3, None, None, None), (None, shared, "en", "s")]
    docs = frame(spark, rows, _doc=1, _hash="x", _text_hash=2, _a=3, _b=4, _spans=5, start_word=6)
    left = substrings.remove_passages(docs, substrings.passages(docs))
    assert left.columns == docs.columns
    got = {r["doc_id"]: r for r in left.collect()}
    assert set(got) == {1, 2, 3, None} and len(got[2]["text"].split()) == 20 and got[None]["text"] == shared and got[1]["_hash"] == "x"


# 4


def test_vectors(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(60, 16))
    rows, k = [], 0
    for v in base:
        for scale in (0, 0.05, 0.1, 0.2):
            rows.append((k, (3 * (v + scale * rng.normal(size=16))).astype(np.float32).tolist(), int(k % 3)))
            k += 1
    rows += [(900, rows[0][1], 0), (900, rows[0][1], 0), (901, [2 * x for x in rows[0][1]], 0), (902, rows[0][1], None), (903, None, 0), (904, [0.0] * 16, 0), (905, [float("nan")] * 16, 0), (906, [None] + [1.0] * 15, 0), (907, [], 0), (908, [1.0, 2.0], 0), (909, [2.0, 4.0], 0), (910, [float("inf")] + [0.0] * 15, 0), (None, [3.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n_links": F.lit(1), "tile": F.lit("x"), "packed": F.lit(None)})
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    links = [sum(i in e for e in linked) for i in range(len(rows))]
    root = brute_components(range(len(rows)), linked)
    smallest = {}
    for i, r in root.items():
        if rows[i][0] is not None:
            smallest[r] = min(smallest.get(r, 1 << 60), rows[i][0])
    want = sorted((rows[i][0] is None, rows[i][0] or 0, links[i], smallest.get(root[i])) for i in range(len(rows)))
    for tile in (7, 2048):
        got = vectors.near_duplicates(df, tile=tile).collect()
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_duplicates(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vectors.near_duplicates(df, threshold=0)


# 5


def test_urls(spark):
    cases = [
        ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("x://m.example.com/de/#a", "m.example.com", "/de/", "com/de/", "block"),
        ("x://m.example.com/fr/?a#b", "m.example.com", "/fr/", "com/fr/", "allow"),
        ("http://notexample.org", "notexample.org", "", None, None),
        ("http://badorg/x", "badorg", "/x", None, None),
        ("http://org/x", "org", "/x", "org/", "allow"),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("a://b?c://d/e", "b", "", None, None),
        ("a://É.NET#x/y", "É.net", "", None, None),
        ("://x.com/de", "x.com", "/de", None, None),
    ]
    df = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["block_probability"] >= 0.5 else "allow"))
    assert urls.filter_urls(df.limit(0)).collect() == []


def test_host_and_path_of_the_table():
    assert urls.split_url("HTTP://A.b/C?d://e") == ("a.b", "/C") and urls.split_url("x") == ("", "")


def test_url_model():
    """Five folds, by host: no host of a fold is in the table that it is judged by."""
    table = urls.labelled_urls()
    hosts = [urls.split_url(u)[0].removeprefix("www.") for u, _ in table]
    assert len(set(hosts)) == len(hosts)
    random.Random(5).shuffle(table)
    right = 0
    for k in range(5):
        w = urls.train([r for i, r in enumerate(table) if i % 5 != k])
        right += sum((urls.probability(*urls.split_url(u), w) >= 0.5) == bool(label) for u, label in table[k::5])
    assert right / len(table) > 0.85
    assert (urls.train(table) == urls.train(table)).all()
    assert urls.probability("x", "", urls.train([])) == 0.5


def test_large_labelled_table_is_sampled(monkeypatch):
    monkeypatch.setattr(urls, "MOST_LABELLED", 20)
    table = urls.labelled_urls()
    assert (urls.train(table) == urls.train(table[::-1])).all() and (urls.train(table) != 0).any()


# 6


def test_sharding(spark, odd, empty):
    rng = random.Random(14)
    rows = [(i, prose(rng, 5), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(1000)] + [(2000 + i, "x", "en", f"only{i}") for i in range(50)]
    got = sharding.shard_documents(frame(spark, rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    counts = [sum(r["shard"] == s for r in got) for s in range(24)]
    assert len(by_id) == 1050 and max(counts) - min(counts) <= 1
    for s in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    # Every shard matches the mixture: a cut moves a source by one row at most for each other source that is off by one.
    few = [r for r in rows if not r[3].startswith("only")]
    places = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame(spark, few)).collect()}
    for source in {src for *_, src in few}:
        own = [sum(places[i] == s for i, _, _, src in few if src == source) for s in range(24)]
        assert all(abs(x - sum(own) / 24) <= 4 for x in own) and sum(abs(x - sum(own) / 24) for x in own) / 24 <= 1
    assert all(by_id[i]["size"] == len(t.encode()) + 8 and by_id[i]["text_crc32"] == zlib.crc32(t.encode()) for i, t, *_ in rows)
    again = sharding.shard_documents(frame(spark, rows[::-1]).repartition(7))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in again.collect()} == {i: (r["shard"], r["slot"]) for i, r in by_id.items()}
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 12 and {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 2} == {(8, 0)}
    assert len({(r["shard"], r["slot"]) for r in rows}) == 12
    assert sharding.shard_documents(empty).collect() == []


def brute_interleave(rows, n_shards, seed, spark):
    """The same order by plain sorting, with Spark's hash values."""
    hashed = spark.createDataFrame(rows, "doc_id long, size long, crc long, key string")
    h = {r[0]: (r[1], r[2]) for r in hashed.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "size", "crc"), F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "key"), 11)).collect()}
    unsigned = lambda x: x % (1 << 64)
    out, by_key = [], {}
    for doc_id, _, _, key in rows:
        by_key.setdefault(key, []).append(doc_id)
    for key, own in by_key.items():
        own.sort(key=lambda i: (unsigned(h[i][0]) >> 52, h[i][0]))
        out += [((rank + h[i][1] / 2**53) / len(own), key, rank, i) for rank, i in enumerate(own)]
    out.sort()
    return {i: place * n_shards // len(out) for place, (*_, i) in enumerate(out)}


def test_sharding_order_is_the_fractional_rank(spark):
    rng = random.Random(15)
    rows = [(i, prose(rng, 3), "en", rng.choice("abbbbc")) for i in range(400)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(frame(spark, rows)).collect()}
    plain = [(i, len(t.encode()) + 8, zlib.crc32(t.encode()), f"{len(s)}:{s}") for i, t, _, s in rows]
    assert got == brute_interleave(plain, 24, sharding.SEED, spark)


# 7


def test_rates_solve_the_problem(spark):
    rng = np.random.default_rng(16)
    n = rng.integers(0, 500, 400).astype(float)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    target = np.array([0.7, 0.2, 0.1])
    members = spark.createDataFrame([(float(a), b.tolist()) for a, b in zip(n, p)], "tokens double, posterior array<double>")
    history, step = mixing.fit_rates(members, target, steps=400, tolerance=1e-6)
    got = mixing.replay(p, history, step, mixing.RIDGE)[0]
    total = n.sum()
    x = np.ones(400)
    size = np.linalg.eigvalsh((p * n[:, None]).T @ p / total).max() + mixing.RIDGE
    for _ in range(30_000):
        x = np.maximum(0, x - (p @ ((x * n) @ p / total - target) + mixing.RIDGE * (x - 1)) / size)
    assert np.abs(got - x).max() < 0.02
    assert np.abs((got * n) @ p / total - target).max() < 0.01
    assert (got >= 0).all()
    assert mixing.fit_rates(members.limit(0), target) == ([], 0.0)


def test_mixing(spark, odd, empty):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(300):
        kind = ("clean", "low", "toxic")[i % 3]
        text = prose(rng, 60)
        text = text.upper().replace(" ", "!! ") if kind == "low" else text + " beast vermin" if kind == "toxic" else text
        rows.append((i, text, "en", "s"))
        if i % 2:
            labels.append((i, kind))
    docs, known = frame(spark, rows), spark.createDataFrame(labels + [(1, None), (None, "clean"), (5000, "low")], "doc_id long, domain string")
    got = {r["doc_id"]: r for r in mixing.rates(docs, known).collect()}
    right = sum(max(mixing.DOMAINS, key=lambda d: got[i][f"p_{d}"]) == ("clean", "low", "toxic")[i % 3] for i in range(0, 300, 2))
    assert right / 150 > 0.95
    tokens = sum(r["tokens"] for r in got.values())
    for d, share in mixing.TARGETS.items():
        assert sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got.values()) / tokens == pytest.approx(share, abs=0.01)
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in got.values())
    mixed = mixing.mix(docs, known)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {i: r["copies"] for i, r in got.items() if r["copies"]}
    assert mixing.rates(odd, known).count() == 12 and mixing.mix(odd, known).columns == odd.columns
    assert mixing.rates(empty, known).collect() == [] and mixing.mix(empty, known.limit(0)).collect() == []
    alike = mixing.rates(docs, known.limit(0)).collect()
    assert all(r["p_low"] == pytest.approx(1 / 3) for r in alike)
    with pytest.raises(ValueError):
        mixing.rates(docs, known, {"clean": -1.0})


def test_mixing_learns_from_words_far_into_a_text(spark):
    rng = random.Random(47)
    rows = [(i, prose(rng, 5000) + (" vermin beast" if i % 2 else " garden music"), "en", "s") for i in range(80)]
    docs = frame(spark, rows)
    known = spark.createDataFrame([(i, "toxic" if i % 2 else "clean") for i in range(40)], "doc_id long, domain string")
    model = mixing.learn_domains(docs, known, ("clean", "toxic"))
    assert {"vermin", "garden"} <= model.vocabulary.keys()
    assert all((model.posterior(t)[1] > 0.5) == bool(i % 2) for i, t, *_ in rows[40:])


# 8


def test_language(spark, odd, empty):
    rng = random.Random(18)
    syllables = {"en": ["th", "ing", "er", "wh", "and", "ly"], "de": ["sch", "ung", "keit", "ich", "ver", "zu"], "fr": ["eau", "oui", "que", "ment", "é", "aux"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    rows = [(i, text(lang, rng.choice([8, 40, 400])), lang, "s") for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = frame(spark, rows, **CLASHES)
    dictionaries = language.learn(docs.where(~language.is_held_out(F.col("doc_id"))))
    assert set(dictionaries) == {"en", "de", "fr"} and all(len(d) <= language.PIECES * (language.PIECE_BYTES + 1) for d in dictionaries.values())
    got = {r["doc_id"]: r for r in language.identify(docs, dictionaries).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and {r["doc_id"] for r in docs.where(language.is_held_out(F.col("doc_id"))).collect()} == set(held)
    assert all(got[i]["lang_pred"] == rows[i][2] for i in held)
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in got.values())
    odd_rows = language.identify(odd, dictionaries).collect()
    assert len(odd_rows) == 12
    for r in odd_rows:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 7) or (r["doc_id"] is None and r["score"] == 0))
        assert r["lang_pred"] in {"und", *dictionaries} and (r["lang_pred"] != "und" or r["rejected"])
    assert language.learn(empty) == {} and language.identify(empty, dictionaries).collect() == []
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        language.identify(docs, dictionaries, keep=["doc_id", "score"])
    many = frame(spark, [(i, text("en", 50), f"l{i % 300}", "s") for i in range(600)])
    assert len(language.learn(many)) == language.MOST_LANGUAGES
    late = [(i, text("fr", 1500) + " " + text(lang, 3000), lang, "s") for i, lang in enumerate(["en", "de"] * 30)]
    learned = language.learn(frame(spark, late))
    assert sum(language.Compressors(learned).classify(text(lang, 60))[0] == lang for lang in ["en", "de"] * 20) >= 38
    assert language.Compressors({"en": b"", "de": dictionaries["de"]}).classify(text("de", 200))[0] == "de"


# 9


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.TOKENIZER), bpe.PrefixBPE(open(bpe.TOKENIZER, "rb").read())


def test_bpe_equals_the_library(tokenizer):
    theirs, mine = tokenizer
    rng = random.Random(19)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "it's they'RE we'll\n\n  x \t y  ", "日本語のテキスト🎉🎉 naïve ﬁ ½ ² ೫", "a" * 5000, " " * 777, "\u0000\u0001\ufeff\u200b\u00a0\u2028x", "1234567890 3.14", prose(rng, 300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice("ab thein\n'sSt.,!") for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    for text, want in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = mine.encode(text)
        assert array("I", ids).tolist() == want.ids
        assert mine.decode(ids) == text == theirs.decode(want.ids, skip_special_tokens=False)


def test_every_token_stands_for_itself(tokenizer):
    _, mine = tokenizer
    assert len(mine.automaton) == len(mine.bytes_of) - len(mine.special)
    ids = [220, 50256, 1, 255, 128, 200]
    raw = b"".join(mine.bytes_of[i] for i in ids)
    assert mine.decode(array("I", ids).tobytes()) == raw.decode("utf-8", "replace")


def test_pre_tokens_agree_for_every_character(tokenizer):
    theirs, mine = tokenizer
    for low in range(0, 0x110000, 4096):
        for ch in map(chr, (c for c in range(low, low + 4096, 5) if not 0xD800 <= c < 0xE000)):
            text = f"a{ch}a1{ch}1!{ch}! {ch}"
            assert len(mine.words(text)) == len(theirs.pre_tokenizer.pre_tokenize_str(text)), hex(ord(ch))


def test_bpe_frames(spark, odd, empty, tokenizer):
    theirs, _ = tokenizer
    got = bpe.round_trip(odd).collect()
    assert len(got) == 12
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd)).collect() if r["doc_id"] is not None}
    assert back == texts
    assert bpe.round_trip(empty).collect() == []


def test_bpe_refuses_other_models():
    with pytest.raises((ValueError, KeyError)):
        bpe.PrefixBPE(b'{"model": {"type": "WordPiece", "vocab": {}}, "pre_tokenizer": {"type": "Whitespace"}}')


# 10


EVENTS = "conv_id long, event_id string, kind string, parent_id string, call_id string, name string, arguments string, role string, content string"


def test_tool_calls(spark):
    schema = {
        "find": {"properties": {"q": {"type": "string", "minLength": 2, "maxLength": 5}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "mode": {"enum": ["a", "b"]}, "x": {"type": "number"}, "ok": {"type": "boolean"}, "l": {"type": "array"}, "o": {"type": "object"}}, "required": ["q"], "additionalProperties": False}
    }
    good = ['{"q": "abc"}', '{"q":"ab","n":3,"mode":"a","x":1.5,"ok":true,"l":[2,{"b":1,"a":2}],"o":{"z":1,"a":{"d":1,"c":2}}}', '{"x": 2, "q": "ab"}']
    bad = ["{}", '{"q": 5}', '{"q": "a"}', '{"q": "abcdef"}', '{"q": "ab", "n": 0}', '{"q": "ab", "n": 1.5}', '{"q": "ab", "mode": "c"}', '{"q": "ab", "y": 1}', "[1]", "{", None, '{"q": null}']
    rows = [(1, f"c{i}", "call", None, f"k{i}", "find", a, None, None) for i, a in enumerate(good + bad)] + [(1, "u", "call", None, "ku", "unknown", "{}", None, None)]
    got = {r["event_id"]: r for r in toolcalls.link(spark.createDataFrame(rows, EVENTS), schema).collect()}
    assert [got[f"c{i}"]["valid"] for i in range(len(good + bad))] == [True] * len(good) + [False] * len(bad) and got["u"]["valid"] is False
    assert got["c1"]["json"] == '{"arguments":{"l":[2,{"a":2,"b":1}],"mode":"a","n":3,"o":{"a":{"c":2,"d":1},"z":1},"ok":true,"q":"ab","x":1.5},"call_id":"k1","name":"find","type":"call"}'
    assert got[f"c{len(good) + 9}"]["json"] == f'{{"arguments":"{{","call_id":"k{len(good) + 9}","name":"find","type":"call"}}'


def test_tool_call_order_and_links(spark):
    rows = [
        (1, "r1", "result", "zz", "a", None, None, None, "late"),
        (1, "c1", "call", "m", "a", "f", "{}", None, None),
        (1, "m", "message", None, None, None, None, "system", "hi\n\"é\""),
        (1, "c2", "call", "r1", "b", "f", "{}", None, None),
        (1, "r9", "result", None, "none", None, None, None, "lost"),
        (1, "x", "message", "y", None, None, None, "user", None),
        (1, "y", "message", "x", None, None, None, "user", "cycle"),
        (1, "self", "message", "self", None, None, None, "user", "self"),
        (2, "r1", "result", None, "a", None, None, None, "other conversation"),
        (2, "m", "message", None, None, None, None, "system", "twice"),
        (2, "m", "message", None, None, None, None, "system", "twice"),
        (None, "q", None, None, None, None, None, None, None),
        (3, None, "call", "m", None, None, None, None, None),
    ] + [(4, str(i), "message", str(i - 1), None, None, None, "user", "t") for i in range(200)]
    out = toolcalls.link(spark.createDataFrame(rows, EVENTS).withColumn("level", F.lit("x")), {}).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["event_id"]): r for r in out}
    assert {e: got[1, e]["level"] for e in ("m", "c1", "r1", "c2", "r9", "x", "y", "self")} == {"m": 0, "c1": 1, "r1": 2, "c2": 3, "r9": 0, "x": None, "y": None, "self": 0}
    assert {e: got[1, e]["linked"] for e in ("c1", "r1", "c2", "r9", "m")} == {"c1": True, "r1": True, "c2": False, "r9": False, "m": None}
    assert got[2, "r1"]["linked"] is False and got[None, "q"]["level"] == 0 and got[3, None]["level"] == 0
    assert got[1, "m"]["json"] == '{"content":"hi\\n\\"é\\"","role":"system","type":"message"}'
    assert [got[4, str(i)]["level"] for i in range(200)] == list(range(200))
    assert toolcalls.link(spark.createDataFrame([], EVENTS), toolcalls.RESPOND).collect() == []


def test_turns_as_events(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 4, "assistant", "gap"), (1, 5, "user", None), (1, None, "user", "x"), (None, 3, "user", "x"), (1, 6, None, "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = toolcalls.link(toolcalls.events_of(conv), toolcalls.RESPOND).collect()
    got = {r["event_id"]: r for r in out}
    assert len(out) == len(rows)
    assert [got[f"1:{t}"]["level"] for t in (0, 1, 2, 4, 5, 6)] == [0, 1, 2, 0, 1, 2]
    assert (got["1:1"]["linked"], got["1:2"]["linked"], got["1:4"]["linked"], got["1:5"]["valid"]) == (True, True, False, False)
