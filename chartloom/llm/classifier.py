"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Words are hashed into ``BUCKETS`` features (log counts, scaled to unit length);
structure and metadata (the ``n_chars`` column) are standardised numbers.  Every
feature has a weight and a vector of ``RANK`` numbers; the score adds the dot
products of all pairs of features, which the identity
sum of pairs = (square of sums - sum of squares) / 2 gives in linear time.

The machine is fitted on at most ``FIT_ROWS`` labelled documents, chosen by
their ids' hashes; features are made and scored inside tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import fresh, table
from chartloom.llm.text_features import STRUCTURE, split_words, structure

BUCKETS, RANK = 2048, 8
NUMBERS = len(STRUCTURE) + 1
FIT_ROWS, ROUNDS, BATCH, RATE, RIDGE = 6000, 30, 128, 0.02, 2e-4
KNOWN_WORDS = 300_000


def held_out(doc_id: Column) -> Column:
    """Rows that fitting must not see: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class _Words:
    """Bucket of each word, remembered in a bounded table."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def features(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, their values, and the numbers."""
        words = split_words(text)
        counts = Counter(words)
        known = self.known
        new = [w for w in counts if w not in known]
        if new:
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = list(counts)
            for w in new:
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        at = np.fromiter(map(known.__getitem__, counts), "int64", len(counts))
        total = np.bincount(at, weights=np.fromiter(counts.values(), "float64", len(counts)), minlength=BUCKETS)
        places = np.flatnonzero(total)
        values = np.log1p(total[places]).astype("float32")
        if len(values):
            values /= np.sqrt((values * values).sum())
        numbers = np.append(structure(text, words, counts), np.float32(np.log1p(max(0, n_chars or 0))))
        return places.astype("int32"), values, numbers.astype("float32")


@dataclass
class Machine:
    """Weights of a fitted factorisation machine."""

    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def numbers(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.mean) / self.spread, -4, 4) / 2

    def score(self, places: np.ndarray, values: np.ndarray, raw: np.ndarray) -> float:
        at = np.concatenate([places, np.arange(BUCKETS, BUCKETS + NUMBERS)])
        x = np.concatenate([values, self.numbers(raw)])
        v = self.vectors[at]
        sums = x @ v
        z = self.bias + x @ self.weight[at] + 0.5 * float((sums * sums).sum() - ((x * x) @ (v * v)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(x: np.ndarray, raw: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Fit by Adam on log loss; ``x`` holds the buckets' values, ``raw`` the numbers."""
    mean, spread = raw.mean(axis=0), np.maximum(raw.std(axis=0), 1e-3)
    size = BUCKETS + NUMBERS
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, "float32"), rng.normal(0, 0.05, (size, RANK)).astype("float32"), mean, spread)
    full = np.concatenate([x, m.numbers(raw).astype("float32")], axis=1)
    squares = full * full
    share = float(np.clip(y.mean(), 0.01, 0.99))
    m.bias = float(np.log(share / (1 - share)))
    state = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in (("w", m.weight), ("v", m.vectors))}
    bias_state, step = [0.0, 0.0], 0

    def adam(key: str, p: np.ndarray, g: np.ndarray, rate: float) -> None:
        a, b = state[key]
        a += 0.1 * (g - a)
        b += 0.001 * (g * g - b)
        p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)

    for turn in range(ROUNDS):
        rate = RATE * (1 - turn / ROUNDS)
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i:i + BATCH]
            xb, sb = full[at], squares[at]
            sums = xb @ m.vectors
            z = m.bias + xb @ m.weight + 0.5 * ((sums * sums) - sb @ (m.vectors * m.vectors)).sum(axis=1)
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)).astype("float32")
            step += 1
            g_v = xb.T @ (d[:, None] * sums) - m.vectors * (sb.T @ d)[:, None]
            adam("w", m.weight, xb.T @ d + RIDGE * m.weight, rate)
            adam("v", m.vectors, g_v + RIDGE * m.vectors, rate)
            g = float(d.sum())
            bias_state[0] += 0.1 * (g - bias_state[0])
            bias_state[1] += 0.001 * (g * g - bias_state[1])
            m.bias -= rate * (bias_state[0] / (1 - 0.9 ** step)) / (np.sqrt(bias_state[1] / (1 - 0.999 ** step)) + 1e-8)
    return m


def _sample(df: DataFrame, labels: DataFrame, text: str, id_: str, chars: str | None, label: str, rows: int) -> pa.Table:
    """Features of at most ``rows`` labelled documents outside the held-out rows."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_).isNotNull() & ~held_out(F.col(id_)))
        .groupBy(F.col(id_).alias("_label_id")).agg(F.max(label).alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(rows)
    )
    n_chars = F.col(chars) if chars else F.lit(None)
    given = df.select(F.col(id_).alias("_id"), F.col(text).alias("_text"), n_chars.cast("long").alias("_chars"))
    # at most ``rows`` ids: a bounded broadcast; one row of a repeated id
    found = given.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).groupBy("_id").agg(
        F.min(F.struct(F.coalesce("_text", F.lit("")).alias("t"), F.col("_chars").alias("c"))).alias("d"), F.first("_label").alias("_label")
    ).select("_label", F.col("d.t").alias("_text"), F.col("d.c").alias("_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Words()
        for batch in batches:
            rows_ = [made.features(t.as_py() or "", c.as_py()) for t, c in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), *[pa.array([r[k].tobytes() for r in rows_], pa.binary()) for k in range(3)]],
                names=["label", "places", "values", "numbers"],
            )

    return found.mapInArrow(run, "label int, places binary, values binary, numbers binary").toArrow()


def train(df: DataFrame, labels: DataFrame, text: str = "text", id_: str = "doc_id", chars: str | None = "n_chars",
          label: str = "quality", rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``rows`` labelled documents; without any it scores everything alike."""
    found = _sample(df, labels, text, id_, chars, label, rows)
    n = found.num_rows
    if n == 0:
        size = BUCKETS + NUMBERS
        return Machine(0.0, np.zeros(size, "float32"), np.zeros((size, RANK), "float32"), np.zeros(NUMBERS), np.ones(NUMBERS))
    x = np.zeros((n, BUCKETS), "float32")
    raw = np.zeros((n, NUMBERS), "float32")
    for i, (places, values, numbers) in enumerate(zip(*[found.column(k).to_pylist() for k in ("places", "values", "numbers")])):
        x[i, np.frombuffer(places, "int32")] = np.frombuffer(values, "float32")
        raw[i] = np.frombuffer(numbers, "float32")
    order = np.lexsort((raw[:, 0], x[:, 0], found.column("label").to_numpy()))
    return fit(x[order], raw[order], found.column("label").to_numpy()[order].astype("float32"))


def score(df: DataFrame, machine: Machine, text: str = "text", chars: str | None = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null texts score like empty ones, null ``n_chars`` like 0.  Repeated rows get
    one score; input columns named like a result are replaced; an empty table
    stays empty.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in {"score", "predicted"}]
    source, number = fresh(df, "fm_text", "fm_chars")
    given = df.select(*kept, F.col(text).alias(source), (F.col(chars) if chars else F.lit(None)).cast("long").alias(number))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Words()
        for batch in batches:
            found = [machine.score(*made.features(t.as_py() or "", c.as_py())) for t, c in zip(batch.column(source), batch.column(number))]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found, pa.float64())], names=[*kept, "score"])

    return given.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality_classifier(spark, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    machine = train(docs, table(spark, folder, "labels").select("doc_id", "quality"))
    return score(docs, machine, keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
