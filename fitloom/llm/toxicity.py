"""Operator 5: toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from confirmed toxic documents (P) and unlabelled text
(U). U is drawn from all documents outside the held-out fold, labelled or not; no label of it is looked at. With the class prior p, the
risk is p R_P(+) + max(0, R_U(-) - p R_P(-)); where the second part turns negative it is the reverse of its gradient that is followed,
so that the classifier does not fit U's hidden toxic documents as clean.

The prior is the share of toxic ones among the labelled documents of the training folds. That is right where labels were given to
documents without regard to their text, as in ``labels``; where they were not, ``Settings.prior`` states it.

The fit reads a bounded sample (``Settings.most_positive`` and ``most_unlabelled`` documents, taken by a hash of the id) and at most
``Settings.features`` features, which are chosen by an aggregate over the sample, so the driver holds at most rows times features
counts; every document is scored. Only rows whose crc32 of the id is not 0 modulo 5 lend labels or text.

Null or empty text has no features and gets the score of the bias. A feature must stand in three confirmed documents, or in all if
there are fewer; without any feature all scores are that of the prior. Null ids are scored, have no label, are not held out and not in
U. If a document has several labels, one toxic label makes it toxic. Without any toxic label all scores are 0. Extra columns are not
looked at. A long text is one row of one task, linear in its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import written

FOLDS = 5


@dataclass(frozen=True)
class Settings:
    most_positive: int = 3_000
    most_unlabelled: int = 6_000
    features: int = 1_500
    hash_bits: int = 24
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    prior: float | None = None


SETTINGS = Settings()
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
REMEMBERED = 1_000_000


def of_word(word: str, settings: Settings) -> tuple[int, ...]:
    """Hashed features of one word: itself and its beginnings."""
    word = word.lower().strip(EDGE)
    if not word:
        return ()
    mask = (1 << settings.hash_bits) - 1
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in {f"={word}", *(word[:n] for n in settings.beginnings if len(word) >= n)})


def counted(text: str, known: dict[str, tuple[int, ...]], settings: Settings) -> dict[int, int]:
    out: dict[int, int] = {}
    for w in text.split():
        found = known.get(w)
        if found is None:
            if len(known) >= REMEMBERED:
                known.clear()
            found = known[w] = of_word(w, settings)
        for f in found:
            out[f] = out.get(f, 0) + 1
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    settings: Settings
    weights: dict[int, float]
    bias: float

    def score(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))) if logit > -np.inf else 0.0


def nnpu_gradient(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Of the non-negative risk with logistic loss, by the logit of each row."""
    s = 1 / (1 + np.exp(-z))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    negative_part = np.logaddexp(0, z[~positive]).mean() - prior * np.logaddexp(0, z[positive]).mean()
    g = np.zeros_like(z)
    if negative_part < 0:
        g[~positive], g[positive] = -s[~positive] / n_u, prior * s[positive] / n_p
    else:
        g[~positive] = s[~positive] / n_u
        g[positive] = prior * (s[positive] - 1) / n_p - prior * s[positive] / n_p
    return g


@dataclass
class Sample:
    """Counts of the chosen features in documents: ``counts[i]`` of feature number ``columns[i]`` in document number ``rows[i]``."""

    positive: np.ndarray
    rows: np.ndarray
    columns: np.ndarray
    counts: np.ndarray


def fit(sample: Sample, chosen: list[int], prior: float, settings: Settings = SETTINGS) -> Model:
    """Rows that aren't confirmed toxic are the unlabelled ones."""
    positive = sample.positive
    if not positive.any():
        return Model(settings, {}, -np.inf)
    x = np.zeros((len(positive), len(chosen) + 1), np.float32)
    x[:, -1] = 1
    x[sample.rows, sample.columns] = np.log1p(sample.counts)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, settings.steps + 1 if chosen else 1):
        g = x.T @ nnpu_gradient(x @ w.astype(np.float32), positive, prior).astype(np.float32) + settings.decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= settings.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(settings, dict(zip(chosen, w[:-1].tolist())), float(w[-1]))


def sampled(docs: DataFrame, labels: DataFrame, settings: Settings) -> tuple[DataFrame, float]:
    """(doc_id, confirmed, text) of P and U, as a table, and the prior. A document may stand in both."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] if settings.prior is None else settings.prior
    by_hash = F.xxhash64("doc_id", F.lit(5))
    take = lambda df, n, confirmed: df.select("doc_id").orderBy(by_hash, "doc_id").limit(n).distinct().withColumn("confirmed", F.lit(confirmed))
    outside = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = take(known.filter("toxic = 1"), settings.most_positive, True).unionByName(take(outside, settings.most_unlabelled, False))
    # At most most_positive + most_unlabelled ids. Of rows that share an id the least text is taken.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "confirmed").agg(F.min("text").alias("text"))
    return written(found, "sample"), min(0.9, max(1e-3, share or 0.0))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    """Fit on the training folds of ``labels`` (doc_id, toxic); ``docs`` has doc_id and text."""
    sample, prior = sampled(docs, labels, settings)
    sizes = {r["confirmed"]: r["n"] for r in sample.groupBy("confirmed").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), max(1, sizes.get(False, 0))
    if not n_p:
        return Model(settings, {}, -np.inf)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for confirmed, text in zip(batch.column("confirmed").to_pylist(), batch.column("text")):
                found = np.fromiter(counted(text.as_py() or "", words, settings), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), confirmed))], ["f", "confirmed"])

    seen, usual = F.col("seen"), F.col("usual")
    every = sample.select("confirmed", "text").mapInArrow(features, "f int, confirmed boolean").groupBy("f").agg(F.count_if("confirmed").alias("seen"), F.count_if(~F.col("confirmed")).alias("usual"))
    lift = (seen / F.lit(float(n_p)) - usual / F.lit(float(n_u))) / F.sqrt((seen + usual) / F.lit(float(n_p + n_u)))
    chosen = sorted(r["f"] for r in every.filter(seen >= min(3, n_p)).orderBy(F.desc(lift), "f").limit(settings.features).collect())
    place = {f: i for i, f in enumerate(chosen)}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for key, confirmed, text in zip(batch.column("doc_id"), batch.column("confirmed"), batch.column("text")):
                found = {place[f]: n for f, n in counted(text.as_py() or "", words, settings).items() if f in place}
                yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([confirmed.as_py()]), pa.array([np.fromiter(found, "<i4").tobytes()]), pa.array([np.fromiter(found.values(), "<i4").tobytes()])], ["id", "confirmed", "f", "c"])

    read = sample.mapInArrow(counts, "id string, confirmed boolean, f binary, c binary")
    rows = sorted((r["id"], r["confirmed"], bytes(r["f"]), bytes(r["c"])) for r in read.toLocalIterator())
    flat = lambda i: np.frombuffer(b"".join(r[i] for r in rows), "<i4")
    return fit(Sample(np.array([r[1] for r in rows], bool), np.repeat(np.arange(len(rows)), [len(r[2]) // 4 for r in rows]), flat(2), flat(3)), chosen, prior, settings)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for t in batch.column("text"):
                counts: dict[int, int] = {}
                for w in (t.as_py() or "").split():
                    found = words.get(w)
                    if found is None:
                        if len(words) >= REMEMBERED:
                            words.clear()
                        found = words[w] = tuple(f for f in of_word(w, model.settings) if f in model.weights)
                    for f in found:
                        counts[f] = counts.get(f, 0) + 1
                scores.append(model.score(model.bias + sum(model.weights[f] * np.log1p(c) for f, c in sorted(counts.items()))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, score double")


def scored(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The query's columns: doc_id, held_out, score, predicted."""
    out = score(docs, train(docs, labels, settings))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
