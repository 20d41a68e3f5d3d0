"""Mixing sources to target weights with soft memberships.

A classifier trained on the labelled table gives every document a posterior over
domains (clean, low and toxic, from the labels' two marks).  Rates per document
are then fitted so that the domains' expected tokens, sum of rate * tokens *
posterior, meet their targets: nonnegative least squares over the domains, by
projected gradient steps from rate 1.  A step needs the domains' expected tokens
only, one small aggregation; a document's rate follows from its posterior and
the errors of the steps so far, so no rates are stored between steps.

Targets come from an anchor domain whose tokens are all used once; every other
domain gets its weight in proportion, as far as its tokens at the highest rate go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import fresh, lean, saved, table, whole
from chartloom.llm.text_features import STRUCTURE, split_words, structure

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.95, "low": 0.05, "toxic": 0.0}
ANCHOR, MAX_RATE = "clean", 1.0
#: labelled documents that the classifier learns from, and words it keeps
FIT_ROWS, VOCABULARY, LEAST_DOCUMENTS = 20_000, 1000, 4
STEPS, CLOSE = 30, 1e-4
#: chance of the anchor domain from which on a document is never thinned out
HOLD = 0.5
#: a rate this close to a whole number counts as it: no document goes for a rounding of the fit
SNAP = 0.05
_LETTERS = re.compile(r"[^\W\d_]+")


def label_domain(quality: Column, toxic: Column) -> Column:
    """Number of the domain that a label names; null without a quality mark."""
    return F.when(toxic == 1, F.lit(2)).when(quality == 1, F.lit(0)).when(quality == 0, F.lit(1))


def domain_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


@dataclass
class DomainModel:
    """Softmax over chosen words' presence and standardised structure numbers."""

    words: dict[str, int]
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def posterior(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words) + len(STRUCTURE) + 1), "float32")
        keys = self.words.keys()
        for i, text in enumerate(texts):
            for w in keys & set(domain_words(text)):
                x[i, self.words[w]] = 1
            found = split_words(text)
            x[i, len(keys):-1] = structure(text, found, Counter(found))
        x[:, len(keys):-1] = np.clip((x[:, len(keys):-1] - self.mean) / self.spread, -4, 4)
        x[:, -1] = 1
        return _softmax(x @ self.weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by full-batch Adam steps."""
    w = np.zeros((x.shape[1], classes), "float32")
    a, b = np.zeros_like(w), np.zeros_like(w)
    want = np.eye(classes, dtype="float32")[y]
    for k in range(1, steps + 1):
        g = x.T @ ((_softmax(x @ w) - want) / len(y)).astype("float32") + ridge * w
        a += 0.1 * (g - a)
        b += 0.01 * (g * g - b)
        w -= 0.1 * (1 - 0.9 * k / steps) * (a / (1 - 0.9 ** k)) / (np.sqrt(b / (1 - 0.99 ** k)) + 1e-8)
    return w


def _labelled(df: DataFrame, labels: DataFrame, text: str, id_: str, rows: int) -> DataFrame:
    """``domain`` and ``text`` of at most ``rows`` labelled documents, chosen by their ids' hashes."""
    domain = label_domain(F.col("quality"), F.col("toxic"))
    chosen = (
        labels.select(F.col(id_).alias("_label_id"), domain.alias("domain")).where("_label_id is not null and domain is not null")
        .groupBy("_label_id").agg(F.max("domain").alias("domain"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(rows)
    )
    given = df.select(F.col(id_).alias("_id"), whole(F.col(text)).alias("text"))
    # a bounded broadcast; one row of a repeated id
    return given.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).groupBy("_id").agg(
        F.first("domain").alias("domain"), F.min("text").alias("text")
    ).select("domain", "text")


def train(df: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", rows: int = FIT_ROWS) -> DomainModel:
    """The domain classifier; words are chosen by chi-square against each domain over the labelled documents."""
    found = saved(_labelled(df, labels, text, id_, rows))
    sizes = Counter({r["domain"]: r["n"] for r in found.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()})
    total = sum(sizes.values())
    if not total:
        return DomainModel({}, np.zeros((len(STRUCTURE) + 1, len(DOMAINS)), "float32"), np.zeros(len(STRUCTURE)), np.ones(len(STRUCTURE)))

    def spread_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = sorted(set(domain_words(t.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(words), pa.int32()), pa.array(words, pa.string())], names=["domain", "word"])

    counts = found.mapInArrow(spread_words, "domain int, word string").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("domain") == k, 1)).alias(f"n{k}") for k in range(len(DOMAINS))]
    ).where(F.col("n") >= LEAST_DOCUMENTS)
    chi = []
    for k in range(len(DOMAINS)):
        expected = F.col("n") * (sizes[k] / total)
        rest = F.col("n") - expected
        chi.append((F.col(f"n{k}") - expected) ** 2 * (1 / F.greatest(expected, F.lit(1e-9)) + 1 / F.greatest(rest, F.lit(1e-9))))
    best = counts.select("word", F.greatest(*chi).alias("chi")).orderBy(F.desc("chi"), "word").limit(VOCABULARY).collect()
    words = {r["word"]: i for i, r in enumerate(best)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers = [], []
            for t in batch.column(1):
                value = t.as_py()
                at.append(sorted(words[w] for w in words.keys() & set(domain_words(value))))
                parts = split_words(value)
                numbers.append(structure(value, parts, Counter(parts)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(numbers, pa.binary())], names=["domain", "at", "numbers"]
            )

    rows_ = found.mapInArrow(features, "domain int, at array<int>, numbers binary").toArrow().to_pylist()
    rows_.sort(key=lambda r: (r["domain"], r["numbers"], r["at"]))
    raw = np.array([np.frombuffer(r["numbers"], "float32") for r in rows_])
    mean, spread = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)
    x = np.zeros((len(rows_), len(words) + len(STRUCTURE) + 1), "float32")
    for i, r in enumerate(rows_):
        x[i, r["at"]] = 1
    x[:, len(words):-1] = np.clip((raw - mean) / spread, -4, 4)
    x[:, -1] = 1
    y = np.array([r["domain"] for r in rows_])
    return DomainModel(words, fit_softmax(x, y, len(DOMAINS)), mean, spread)


def posteriors(df: DataFrame, model: DomainModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) with ``n_tokens`` (words) and ``posterior`` (doubles by domain)."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in {"n_tokens", "posterior"}]
    (source,) = fresh(df, "mix_text")
    given = df.select(*kept, whole(F.col(text)).alias(source))
    schema = T.StructType([
        *[df.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            # a few rows at a time: features are dense
            for start in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(start, 512)
                texts = batch.column(source).to_pylist()
                p = model.posterior(texts).astype("float64")
                yield pa.RecordBatch.from_arrays(
                    [*batch.select(kept).columns, pa.array([len(split_words(t)) for t in texts], pa.int64()),
                     pa.array(p.tolist(), pa.list_(pa.float64()))],
                    names=[*kept, "n_tokens", "posterior"],
                )

    return given.mapInArrow(lean(run), schema)


def rates(posterior: np.ndarray, errors: list[list[float]], anchor: str, max_rate: float) -> np.ndarray:
    """Documents' rates after gradient steps with these domain errors, each projected to the allowed rates.

    Rates lie in 0 .. ``max_rate``; a document that belongs to the anchor with a
    chance of ``HOLD`` or more has at least 1, as the anchor's tokens are all used.
    """
    least = np.where(posterior[:, DOMAINS.index(anchor)] >= HOLD, min(1.0, max_rate), 0.0)
    r = np.clip(np.ones(len(posterior)), least, max_rate)
    for e in errors:
        r = np.clip(r - posterior @ np.array(e), least, max_rate)
    return r


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))


def with_rates(soft: DataFrame, errors: list[list[float]], anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> DataFrame:
    """The table of posteriors with ``rate``."""
    schema = T.StructType([*soft.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rates(_matrix(batch.column("posterior")), errors, anchor, max_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "rate"])

    return soft.mapInArrow(run, schema)


def targets(available: list[float], weights: dict[str, float], anchor: str, max_rate: float) -> list[float]:
    """Expected tokens wanted of each domain."""
    base = available[DOMAINS.index(anchor)] / weights[anchor]
    return [min(max_rate * a, base * weights.get(d, 0.0)) for d, a in zip(DOMAINS, available)]


def fit_rates(soft: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str = ANCHOR, max_rate: float = MAX_RATE) -> tuple[list[list[float]], list[float], list[float]]:
    """(errors of the steps, targets, expected tokens reached) over a table with n_tokens and posterior."""

    def expected(errors: list[list[float]]) -> list[float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(DOMAINS))
            for batch in batches:
                p = _matrix(batch.column(1))
                r = rates(p, errors, anchor, max_rate)
                total += (r * batch.column(0).to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"d{k}" for k in range(len(DOMAINS))])

        names = [f"d{k}" for k in range(len(DOMAINS))]
        sums = soft.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"{n} double" for n in names))
        row = sums.agg(*[F.sum(n) for n in names]).first()
        return [float(x or 0.0) for x in row]

    available = expected([])
    want = targets(available, weights, anchor, max_rate)
    errors: list[list[float]] = []
    reached, total = available, max(1.0, sum(available))
    for _ in range(STEPS):
        step = [(r - t) / max(a, 1.0) for r, t, a in zip(reached, want, available)]
        after = expected([*errors, step])
        errors.append(step)
        if max(abs(x - y) for x, y in zip(after, reached)) < CLOSE * total:
            reached = after
            break
        reached = after
    return errors, want, reached


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies of a document: the rate, rounded up as often as its fraction says, by the key's hash."""
    snapped = F.when(F.abs(rate - F.round(rate)) <= SNAP, F.round(rate)).otherwise(rate)
    draw = F.shiftrightunsigned(F.xxhash64(*key, F.lit("copies")), 11) / F.lit(float(1 << 53))
    return (F.floor(snapped) + (draw < snapped - F.floor(snapped)).cast("int")).cast("int")


def mixed(df: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", keep: list[str] | None = None, **fitting) -> DataFrame:
    """The columns in ``keep`` (all by default) with ``n_tokens``, ``posterior``, ``rate`` and ``copies``.

    Null and empty texts have no tokens and a posterior like any other.  Labels
    without a quality mark are left out, repeated labels count once.  Without
    labels all domains are alike.  Repeated rows get one rate; input columns
    named like a result are replaced; an empty table stays empty.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in {"n_tokens", "posterior", "rate", "copies"}]
    model = train(df, labels, text, id_)
    soft = saved(posteriors(df, model, text, kept if id_ in kept else [*kept, id_]))
    errors, _, _ = fit_rates(soft, **fitting)
    bounds = {k: v for k, v in fitting.items() if k != "weights"}
    out = with_rates(soft, errors, **bounds)
    return out.withColumn("copies", copies(F.col("rate"), F.col(id_), F.col("n_tokens"))).select(*kept, "n_tokens", "posterior", "rate", "copies")


def op7_mixing(spark, folder: str) -> DataFrame:
    """Tokens, domain posteriors, rate and copies of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = mixed(docs, table(spark, folder, "labels"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_tokens", *[F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", "copies"
    )


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as its copies say; toxic documents have none."""
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")  # keeps clashing names apart
    model = train(docs, table(spark, folder, "labels"))
    errors, _, _ = fit_rates(saved(posteriors(docs, model, keep=[])))
    # texts are scored again with the rates known, rather than kept with their posteriors
    out = with_rates(posteriors(row, model, keep=["row", "doc_id"]), errors)
    times = copies(F.col("rate"), F.col("doc_id"), F.col("n_tokens"))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.when(times > 0, times))).alias("copy")).select("row.*")
