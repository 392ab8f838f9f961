"""Mixing to target weights by soft membership.

A classifier learned from a labelled table gives every document a posterior over domains. With n tokens and posterior p,
a document taken at rate r adds r * n * p[k] expected tokens to domain k. The rates r >= 0 are fitted by projected gradient
(with momentum) to the least-squares problem

    min_r  1/2 sum_k ((T_k(r) - t_k) / N)^2  +  RIDGE/2 sum_i (n_i / N) (r_i - 1)^2,      T_k(r) = sum_i r_i n_i p_ik,

whose second part makes the answer unique: the rates nearest to 1. N is the number of tokens, t_k = weight_k * budget * N.

Scale: a step needs the K sums T_k only. The table (tokens, posterior) is written once to the checkpoint folder; the rate of
a row after any number of steps follows from its posterior and the steps' K-vectors, so no rates are stored or shuffled
between steps and each step is one scan with a K-number result per partition. The classifier is learned from the whole texts
of at most ``PER_DOMAIN`` documents of each domain. The tasks make their features, and the driver gets these only: counts of
``MOST_WORDS`` words, and at most as many numbers a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, map_rows, read_table, rows_of

DOMAINS = ("clean", "low", "toxic")
#: Target share of the tokens of each domain.
TARGETS = {"clean": 0.92, "low": 0.05, "toxic": 0.03}
PER_DOMAIN, MOST_WORDS, LEAST_DOCS = 1000, 2000, 5
RIDGE, STEPS, TOLERANCE = 1e-3, 60, 1e-3
_WORD = re.compile(r"\w+")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.")


def shape(text: str, words: list[str], distinct: int) -> list[float]:
    """Shares that tell prose from junk: capitals, digits, odd marks, repeated words, and the words' length."""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    return [1.0, *((len(raw) - len(raw.translate(None, x))) / n for x in (_UPPER, _DIGIT, _MARKS)), 1 - distinct / max(1, len(words)), min(1.0, n / max(1, len(words)) / 20)]


class Classifier:
    """Softmax regression on the presence of words and on the text's shape."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: np.ndarray):
        self.vocabulary, self.weights, self.bias = vocabulary, weights, bias

    @staticmethod
    def features(text: str, vocabulary: dict[str, int]) -> tuple[list[int], list[float]]:
        words = _WORD.findall(text.lower())
        distinct = set(words)
        return [vocabulary[w] for w in distinct & vocabulary.keys()], shape(text, words, len(distinct))

    def posterior(self, text: str | None) -> list[float]:
        present, form = self.features(text or "", self.vocabulary)
        z = self.bias + self.weights[present].sum(axis=0) + np.array(form) @ self.weights[len(self.vocabulary) :]
        e = np.exp(z - z.max())
        return (e / e.sum()).tolist()

    @classmethod
    def learn(cls, rows: list[tuple[int, list[int], list[float]]], vocabulary: dict[str, int], prior: np.ndarray, rounds: int = 400, rate: float = 1.0, l2: float = 1e-3) -> Classifier:
        """From (domain number, features). The bias is corrected from the sample's shares to ``prior``."""
        k = len(prior)
        x = np.zeros((len(rows), len(vocabulary) + 6), np.float32)
        for i, (_, present, form) in enumerate(rows):
            x[i, present] = 1
            x[i, len(vocabulary) :] = form
        y = np.zeros((len(rows), k), np.float32)
        y[np.arange(len(rows)), [d for d, _, _ in rows]] = 1
        w, step = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
        scale = rate / max(1.0, float((x * x).sum(axis=1).mean()) / 4 if len(rows) else 1.0)
        for _ in range(rounds if len(rows) else 0):
            z = x @ (w + 0.9 * step)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            step = 0.9 * step - scale * (x.T @ (e / e.sum(axis=1, keepdims=True) - y) / len(rows) + l2 * w)
            w = w + step
        share = np.bincount([d for d, _, _ in rows], minlength=k) / max(1, len(rows))
        seen = (share > 0) & (prior > 0)
        bias = np.where(seen, np.log(np.where(seen, prior, 1)) - np.log(np.where(seen, share, 1)), -30.0 if rows else 0.0)
        return cls(vocabulary, w.astype(np.float64), bias)


def _word_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for domain, text in rows:
        for w in set(_WORD.findall(text.lower())):
            yield domain, w


def learn_domains(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS) -> Classifier:
    """The classifier from ``labels`` (doc_id, domain) and the texts of ``docs``; other domains than ``domains`` and nulls are passed over.

    Words of at least LEAST_DOCS documents of the sample, the MOST_WORDS whose use differs most between domains, are its vocabulary."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("domain")).where(F.col("domain").isin(*domains) & F.col("doc_id").isNotNull())
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64(F.lit(5), "doc_id")
    under = F.lit(False)
    for d, n in counts.items():
        under = under | ((F.col("domain") == d) & (F.shiftrightunsigned(h, 11) <= int(min(1.0, 2 * PER_DOMAIN / n) * (1 << 53))))
    chosen = known.where(under).withColumn("h", h).distinct()  # about 2 * PER_DOMAIN rows of each domain
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id").select("domain", "h", "text").distinct().withColumn("tie", F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("domain").orderBy("h", "tie"))
    number = F.create_map(*(x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))))[F.col("domain")]
    sample = cut(found.withColumn("first", first).where(F.col("first") <= PER_DOMAIN).select(number.alias("domain"), "text").repartition(16))
    sizes = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Classifier.learn([], {}, np.zeros(len(domains)))
    shares = [F.sum(F.when(F.col("domain") == k, 1).otherwise(0)) / F.lit(float(n)) for k, n in sizes.items()]
    shares += [F.lit(0.0)] if len(sizes) < len(domains) else []
    spread = F.greatest(*shares) - F.least(*shares) if len(shares) > 1 else F.lit(0.0)
    words = map_rows(sample, lambda: _word_rows, "domain int, word string").groupBy("word").agg(F.count("*").alias("n"), spread.alias("spread"))
    used = words.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("spread"), "word").limit(MOST_WORDS).select("word").collect()
    vocabulary = {r["word"]: i for i, r in enumerate(used)}

    def featured(rows: Iterator[tuple]) -> Iterator[tuple]:
        for domain, text in rows:
            present, form = Classifier.features(text, vocabulary)
            yield domain, sorted(present), form

    rows = [(r["domain"], r["present"], r["form"]) for r in map_rows(sample, lambda: featured, "domain int, present array<int>, form array<double>").collect()]
    total = max(1, sum(counts.values()))
    return Classifier.learn(sorted(rows), vocabulary, np.array([counts.get(d, 0) / total for d in domains]))


def replay(posteriors: np.ndarray, history: list[tuple[np.ndarray, float]], step: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps of ``history``, each an error vector and a momentum, from rates of 1; and where momentum
    carries them, which is where the next error is taken."""
    r = ahead = np.ones(len(posteriors))
    for e, momentum in history:
        new = np.maximum(0.0, ahead - step * (posteriors @ e + ridge * (ahead - 1)))
        ahead, r = new + momentum * (new - r), new
    return r, ahead


def fit_rates(members: DataFrame, targets: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(history, step) for ``replay``, from (tokens double, posterior array<double>). targets: weight * budget of each domain.

    Stops after ``steps``, or when rates and totals have settled to ``tolerance`` times the totals' distance from the targets at rates of 1.
    """
    k = len(targets)

    def sums(history: list, step: float, outer: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + 2 * k + (k * k if outer else 0))
            for b in batches:
                if b.num_rows:
                    n = b.column(0).to_numpy(zero_copy_only=False)
                    p = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
                    at_new, at_ahead = replay(p, history, step, ridge)
                    total[0] += n.sum()
                    total[1 : 1 + k] += (n * at_ahead) @ p
                    total[1 + k : 1 + 2 * k] += (n * at_new) @ p
                    if outer:
                        total[1 + 2 * k :] += ((p * n[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], schema=arrow_schema("i int, s double"))

        got = members.select("tokens", "posterior").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(1 + 2 * k + (k * k if outer else 0))
        for r in got:
            out[r["i"]] = r["s"]
        return out

    first = sums([], 0.0, True)
    n = first[0]
    if not n:
        return [], 0.0
    step = 1 / (np.linalg.eigvalsh(first[1 + 2 * k :].reshape(k, k) / n).max() + ridge)
    history: list[tuple[np.ndarray, float]] = []
    t, now = 1.0, first
    start = max(1e-12, float(np.abs(first[1 : 1 + k] / n - targets).max()))
    before = None
    while len(history) < steps:
        e = now[1 : 1 + k] / n - targets
        longer = (1 + np.sqrt(1 + 4 * t * t)) / 2
        history.append((e, (t - 1) / longer))
        t = longer
        now = sums(history, step, False)
        totals = now[1 + k : 1 + 2 * k] / n
        if before is not None and np.abs(totals - before).max() < tolerance * start and np.abs(totals - targets).max() < max(tolerance, 10 * ridge) * start:
            break
        before = totals
    return history, step


def members_of(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, tokens, posterior) of every row; tokens are the words of the whole text (null: none)."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # MOST_WORDS rows of weights

    def make():
        model = shared.value
        return lambda rows: ((d, float(len((t or "").split())), model.posterior(t)) for d, t in rows)

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, tokens double, posterior array<double>")


def copies_of(rate: float, doc_id: int | None) -> int:
    """The whole part of the rate, and one more with the probability of the rest; the draw is a hash of the id."""
    whole = int(rate)
    return whole + (xxhash.xxh64_intdigest(str(doc_id), 7) / 2**64 < rate - whole)


def _plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float):
    domains = tuple(targets)
    weights = np.array([targets[d] for d in domains], float)
    if (weights < 0).any() or not weights.sum():
        raise ValueError("targets must be nonnegative and not all zero")
    classifier = learn_domains(docs, labels, domains)
    members = cut(members_of(docs, classifier))
    history, step = fit_rates(members, weights / weights.sum() * budget)
    return classifier, members, history, step


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """doc_id, tokens, one posterior column p_<domain> for each target, rate, copies of every row of ``docs``.

    ``labels``: doc_id, domain. Null or empty texts have no tokens and the posterior of an empty text. Without labels all
    domains are alike. An empty table gives an empty table; repeated rows are rated alike; other columns are ignored.
    """
    _, members, history, step = _plan(docs, labels, targets, budget)
    domains = list(targets)
    ddl = "doc_id long, tokens long, " + "".join(f"p_{d} double, " for d in domains) + "rate double, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(domains))
            r = replay(p, history, step, RIDGE)[0]
            copies = [copies_of(x, i) for x, i in zip(r.tolist(), b.column(0).to_pylist(), strict=True)]
            columns = [b.column(0), b.column(1).cast(pa.int64()), *(pa.array(p[:, k].copy()) for k in range(len(domains))), pa.array(r), pa.array(copies, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema(ddl))

    return members.mapInArrow(run, ddl)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = 1.0) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says. Posteriors are computed again from the texts, so nothing is joined."""
    classifier, _, history, step = _plan(docs, labels, targets, budget)
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index("text")
    key = docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            read = [(i, model.posterior(text)) for i, text in rows_of(iter([batch.select([key, at])]))]
            r = replay(np.array([p for _, p in read]).reshape(len(read), -1), history, step, RIDGE)[0].tolist()
            take = [n for n, ((i, _), x) in enumerate(zip(read, r, strict=True)) for _ in range(copies_of(x, i))]
            yield batch.take(pa.array(take, pa.int64()))

    return docs.mapInArrow(run, docs.schema)


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from (doc_id, quality, toxic): toxic, else low or clean by quality; null where nothing is known."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(read_table(spark, sf_dir, "documents"), label_domains(read_table(spark, sf_dir, "labels")))
