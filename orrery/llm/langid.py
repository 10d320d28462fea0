"""Language identification (operator 1).

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams, trained with
follow-the-regularised-leader (proximal, per coordinate) under an elastic-net penalty; a temperature
fitted on rows kept out of training calibrates the scores.

The term frequency of an n-gram is its share of all n-grams of the lowered text, so a text's scores are
the mean of one table row for each n-gram, and a text of any length is scored whole in pieces.

Training takes a bounded sample: of the ``LANGUAGES`` labels with the most rows each the ``per_language`` distinct rows with the
smallest hash of doc_id and text, up to ``BYTES`` of text for a label; longer texts are not learned from.  These bounds hold before anything
comes to the driver, whatever labels, texts or repeats the table has.  Everything else covers all rows.

Defined results: null text and text without a letter get ``und`` and score 0; with no labelled row
to learn from every text gets that; labels beyond ``LANGUAGES`` are not learned; equal scores go to the language first by code point; rows
with null doc_id are predicted but neither learned from nor held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import release

BITS = 18
ORDERS = (1, 2, 3, 4)
#: Bounds of the training sample: labels, rows of each, and bytes of text of each.
LANGUAGES, PER_LANGUAGE, BYTES = 64, 400, 3_000_000
PIECE = 1 << 19
SCALE = 64.0
UND = "und"
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of the lowered text, orders and pieces one after the other."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(code), PIECE):
        for n in ORDERS:
            part = code[at : at + PIECE + n - 1]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n * 0x632BE5AB & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ part[k : k + len(h)]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages in code-point order; a table row (idf times weights) for each hash; bias; temperature."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, count = np.zeros(len(self.langs)), 0
        for g in grams(text):
            for at in range(0, len(g), 1 << 14):
                total += self.table[g[at : at + (1 << 14)]].sum(0, dtype=np.float64)
            count += len(g)
        return total / max(count, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UND, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(np.argmax(z))
        return self.langs[best], float(p[best] / p.sum())


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([*grams(text), np.zeros(0, np.uint32)])
    where, n = np.unique(every, return_counts=True)
    return where.astype(np.int64), n / max(len(every), 1)


def fit(texts: list[str], labels: list[str], epochs: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02, kept: int = 5) -> Model:
    """Train on the given rows; every ``kept``-th row only fits the temperature."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    number = {x: k for k, x in enumerate(langs)}
    rows = [(*_features(t), number[y]) for t, y in zip(texts, labels, strict=True)]
    train = [r for i, r in enumerate(rows) if i % kept] or rows
    dev = [r for i, r in enumerate(rows) if i % kept == 0] or rows
    df = np.zeros(1 << BITS)
    for f, _, _ in train:
        df[f] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    shape = ((1 << BITS) + 1, len(langs))
    z, n = np.zeros(shape), np.zeros(shape)

    def weights(f: np.ndarray) -> np.ndarray:
        zf, nf = z[f], n[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2)
        return np.where(np.abs(zf) <= l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            f, tf, y = train[i]
            f, x = np.append(f, 1 << BITS), np.append(tf * idf[f] * SCALE, 1.0)
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - step * w
            n[f] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    model = Model(langs, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], 1.0)
    logits = np.array([tf @ model.table[f] + model.bias for f, tf, _ in dev])
    gold = np.array([y for *_, y in dev])

    # Platt's targets: a row that is told right is not told with certainty, so separable rows leave t above 0
    sure = (len(gold) + 1) / (len(gold) + 2)
    target = np.full(logits.shape, (1 - sure) / max(len(langs) - 1, 1))
    target[np.arange(len(gold)), gold] = sure

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - (target * s).sum(1)))

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):  # golden section on log t
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, most: int = BYTES) -> list[tuple[str, str]]:
    """(text, lang) of the rows to learn from, in a fixed order."""
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40))
    rows = docs.select("lang", "text", place.alias("place")).where(F.col("text").rlike("\\p{L}") & (F.octet_length("text") <= most))
    # distinct rows are estimated, as repeats are learned from once
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("place").alias("distinct")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    keep = F.lit(False)
    for r in counts:
        # a little more than is wanted, so that chance seldom leaves less
        share = min(1.0, 1.1 * (1.3 * per_language + 30) / max(r["distinct"], 1))
        keep |= (F.col("lang") == r["lang"]) & (F.col("place") < F.lit(int(share * (1 << 40))))
    if not counts:
        return []
    some = rows.where(keep).groupBy("lang", "place").agg(F.min(F.octet_length("text")).alias("bytes"))
    left, chosen = {r["lang"]: (per_language, most) for r in counts}, []
    for r in sorted(some.collect(), key=lambda r: (r.place, r.lang)):
        n, size = left[r.lang]
        if n and r.bytes <= size:
            left[r.lang] = n - 1, size - r.bytes
            chosen.append((r.lang, r.place))
    names = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, place long"))
    found = rows.join(names, ["lang", "place"]).groupBy("place", "lang").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.lang) for r in sorted(found, key=lambda r: (r.place, r.lang))]


def train(docs: DataFrame, held_out: int | None = 1, **bounds: int) -> Model:
    """Learn from text and lang of labelled rows outside the held-out fold; ``bounds``: those of ``sample``."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null")
    if held_out is not None:
        rows = rows.where(fold(F.col("doc_id")) != held_out)
    found = sample(rows, **bounds)
    return fit([t for t, _ in found], [y for _, y in found])


def identify(docs: DataFrame, model: Model, *more: Column | str) -> DataFrame:
    """Columns ``more`` of ``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**BITS rows of one float for each language
    kept = docs.select(*more, F.col("text").alias("_text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(len(names))
            out = [model.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*names, "lang_pred", "score"])
        release()

    schema = kept.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(run, schema)
