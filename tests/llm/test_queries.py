"""Every query over small whole tables with nulls, repeated rows, long texts and columns of clashing names; and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkloom.llm import queries

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn int, role string, text string",
}
CLASH = ("_doc", "_hash", "_text_hash", "_a", "_b", "root", "key", "n", "fp", "h", "band", "part", "rate", "level", "_up", "host", "packed", "range", "size", "slot")
SYLLABLES = {"en": ["th", "ing", "er", "wh", "and", "ly"], "de": ["sch", "ung", "keit", "ich", "ver", "zu"], "fr": ["eau", "oui", "que", "ment", "é", "aux"]}


def rows_of_tables():
    rng = random.Random(51)

    def prose(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    docs = [(i, prose(lang, rng.choice([9, 60, 200])), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de", "fr"] * 30)]
    shared = prose("en", 80)
    docs += [(200, prose("en", 40) + " " + shared, "en", "s0"), (201, prose("en", 90) + " " + shared + " " + prose("en", 50), "en", "s0")]
    long = [d for d in docs if len(d[1].split()) == 200]
    docs += [(300, *long[0][1:]), (301, long[1][1].replace(" ", "  ", 1) + " so", long[1][2], None), (301, long[1][1] + " so", long[1][2], None)]
    docs += [(400, None, None, None), (401, "", "en", "s0"), (402, " \n ", None, "s0"), (None, prose("fr", 70), "fr", "s2"), (None, None, None, None), (403, "12 !!", "en", "s0"), (404, prose("de", 20_000), "de", "s1")]
    docs = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(1, 1, 0), (None, 1, 1), (5, None, None), (9999, 0, 0)]
    vectors = [(i, [float(i % 5 == k) + 0.01 * rng.random() for k in range(6)], i % 3) for i in range(60)] + [(60, None, 1), (61, [0.0] * 6, 1), (62, [1.0] * 6, None), (63, [], 0), (64, [float("nan")] * 6, 0)]
    pages = [(1, "https://a.example.org/es/x", "h"), (2, None, None), (3, "", ""), (None, "ftp://b.com/fr/", "h"), (4, "x://" + "y" * 5000, "h"), (4, "x://" + "y" * 5000, "h")]
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q" * 5), (1, 2, "assistant", None), (1, 3, "user", None), (1, 4, "assistant", "a"), (2, 1, "user", ""), (2, 5, "user", "z" * 5000), (3, 0, "assistant", "b"), (3, 1, "user", 'q"\\\n'), (3, 2, None, None), (3, 3, "assistant", "c")]
    return dict(documents=docs, labels=labels, embeddings=vectors, pages=pages, conversations=turns)


@pytest.fixture(scope="module", params=["full", "empty"])
def tables(request, spark, tmp_path_factory):
    """(folder, rows by table); "empty": the same tables without rows."""
    top = tmp_path_factory.mktemp(request.param)
    rows = {name: own if request.param == "full" else [] for name, own in rows_of_tables().items()}
    for name, ddl in TABLES.items():
        df = spark.createDataFrame(rows[name], ddl)
        clash = {c: F.lit(7) for c in CLASH if c not in df.columns}
        df.withColumns(clash).coalesce(2).write.parquet(f"{top}/{name}.parquet")
    return str(top), rows


KEYS = {1: "documents", 2: "documents", 4: "embeddings", 5: "pages", 6: "documents", 7: "documents", 8: "documents", 9: "documents", 10: "conversations"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    folder, rows = tables
    got = queries.QUERIES[name](spark, folder).collect()
    n = int(name[2:].split("_")[0])
    if n in KEYS:
        assert len(got) == len(rows[KEYS[n]])
    elif rows["documents"]:
        assert {r["doc_id"] for r in got} >= {201, 300, 301} and all(r["ref_doc_id"] < r["doc_id"] for r in got)
    else:
        assert got == []


def test_columns_that_follow_from_the_texts(spark, tables):
    folder, rows = tables
    texts = sorted((d is None, d or 0, t or "") for d, t, *_ in rows["documents"])
    of = lambda name, *columns: sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in columns)) for r in queries.QUERIES[name](spark, folder).collect())
    assert of("op2_lz_fingerprint", "n_chars") == sorted((a, b, len(t)) for a, b, t in texts)
    assert of("op6_sharding", "size", "text_crc32") == sorted((a, b, len(t.encode()) + 8, zlib.crc32(t.encode())) for a, b, t in texts)
    assert of("op9_bpe", "decoded_sha256") == sorted((a, b, hashlib.sha256(t.encode()).hexdigest()) for a, b, t in texts)
    assert of("op8_language", "held_out") == sorted((a, b, not a and zlib.crc32(str(b).encode()) % 4 == 2) for a, b, _ in texts)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, tables, name):
    folder, rows = tables
    if name == "op4_embedding_near_dedup" and not rows["embeddings"]:
        pytest.skip("no rows on both sides")
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, folder).select(*want.columns)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen.append((name, out.collect()))
        docs = spark.createDataFrame(seen[-1][1], out.schema)
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    if not rows["documents"]:
        assert all(found == [] for _, found in seen)
        return
    by = dict(seen)
    texts = {(r["doc_id"], r["text"]) for r in by["language"]}
    lettered = [(r[0], r[1]) for r in rows["documents"] if r[1] and any(map(str.isalpha, r[1]))]
    assert texts <= set(lettered) and texts >= {r for r in lettered if len(r[1].split()) >= 60}
    assert all(r["lang"] in SYLLABLES and r["n_chars"] == len(r["text"]) for r in by["language"])
    assert {(r["doc_id"], r["text"]) for r in by["near_duplicates"]} < texts and {r["doc_id"] for r in by["near_duplicates"]}.isdisjoint({300, 301})
    cut = {r["doc_id"]: r["text"].split() for r in by["repeated_passages"]}
    assert len(cut[201]) <= 145 and len(cut[200]) == 120 and len(by["near_duplicates"]) == len(cut)
    assert {r["doc_id"] for r in by["mixing"]} <= set(cut)
    assert sorted(r["n_tokens"] for r in by["bpe"]) and len(by["bpe"]) == len(by["mixing"])
    assert corpus_pipeline.run(spark, folder).count() == len(by["bpe"])


def test_repeated_passage_whose_pieces_stand_nearer(spark):
    """An edited copy is cut, though each run of equal words in it stands in a nearer document that has a piece of the passage only."""
    body = lambda name, n: [f"{name}{i}" for i in range(n)]
    shared = body("s", 60)
    texts = {1: body("a", 40) + shared} | {i: body(f"p{i}q", 30) + shared[a:b] + body(f"r{i}q", 30) for i, a, b in ((2, 0, 25), (3, 18, 43), (4, 36, 60))}
    texts[5] = body("e", 35) + [f"new{i}" if i in (20, 40) else w for i, w in enumerate(shared)] + body("f", 45)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", len(" ".join(t))) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert left == texts | {5: texts[5][:35] + texts[5][95:]}
