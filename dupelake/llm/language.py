"""Language identification by averaged hashed subword embeddings with a linear softmax.

The subwords of a text are the byte n-grams of its lower-case words, with a blank at either end of a word; each is hashed to a
row of an embedding matrix. The text's vector is their average, and a softmax layer gives the languages. Both are trained
together by stochastic gradient descent on a bounded sample of labelled rows, spread over the languages. A temperature fitted on
held-back rows calibrates the score, and a threshold fitted there lets ``identify(..., reject=True)`` answer ``und`` where the
score does not reach the precision asked for. As everything after the hash is linear, scoring needs one small table.

Defined cases: null texts and texts without letters get ``und`` and score 0; rows with a null id or language never train; without
training rows every text gets ``und``; repeated rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from .bwt import rolling
from .common import crc_fold

ORDERS = (3, 4, 5)
BUCKETS, DIMENSIONS = 8_192, 16
#: Training rows, all languages together, and languages.
SAMPLE_ROWS, MOST_LANGUAGES = 2_400, 400
PRECISION = 0.99
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = np.full(256, 32, np.uint8)
for _c in (*range(97, 123), *range(128, 256)):
    _BLANK[_c] = _c


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every subword of the texts."""
    raws = [b" " + (t or "").lower().encode() + b" " for t in texts]
    data = _BLANK[np.frombuffer(b"".join(raws), np.uint8)]
    ends = np.cumsum([len(r) for r in raws])
    row = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    blank = np.concatenate(([0], np.cumsum(data == 32)))
    rows, buckets = [], []
    for n in ORDERS:
        h = rolling(data, n)
        i = np.arange(len(h))
        inner = blank[i + n - 1] - blank[i + 1]  # blanks that are neither first nor last
        whole = (inner == 0) & (i + n <= ends[row[:len(h)]])
        rows.append(row[:len(h)][whole])
        buckets.append((h[whole] >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(rows), np.concatenate(buckets)


def _parts(texts: list[str | None], most: int = 1 << 18):
    """Runs [a, b) of texts of about ``most`` characters together."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if i > a and n + len(t or "") > most:
            yield a, i
            a, n = i, 0
        n += len(t or "")
    if a < len(texts):
        yield a, len(texts)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        row, bucket = subwords(texts)
        count = np.maximum(1, np.bincount(row, minlength=len(texts)))[:, None]
        total = np.stack([np.bincount(row, self.table[bucket, c], len(texts)) for c in range(len(self.languages))], axis=1)
        z = (total / count + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def training_rows(docs: DataFrame, admitted, sample_rows: int = SAMPLE_ROWS) -> list:
    """lang, buckets, shares of about ``sample_rows`` admitted rows, taken by the hash of their id, the same number a language."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & admitted(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    each = max(20, sample_rows // len(counts))
    rate = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "lang string, rate double")
    picked = rows.join(F.broadcast(rate), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    kind = StructType([StructField("doc_id", LongType()), StructField("lang", StringType()), StructField("buckets", ArrayType(IntegerType())),
                       StructField("shares", ArrayType(FloatType()))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if not _LETTER.search(text):
                    continue
                _, bucket = subwords([text])
                n = np.bincount(bucket, minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                                                  pa.array([(n[at] / max(1, n.sum())).astype(np.float32)], pa.list_(pa.float32()))], names=kind.names)

    got = picked.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(run, kind).limit(4 * sample_rows).collect()
    return sorted(got, key=lambda r: (r["doc_id"], r["lang"]))


def train(rows: list, epochs: int = 12, rate: float = 20.0, batch: int = 32, seed: int = 5) -> LanguageModel:
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return LanguageModel(["und"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    w, b = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    y = np.array([languages.index(r["lang"]) for r in rows])
    xs = [(np.array(r["buckets"], np.int64), np.array(r["shares"])) for r in rows]
    held = np.zeros(len(rows), bool)
    held[rng.permutation(len(rows))[: len(rows) // 5]] = True
    train_at = np.flatnonzero(~held)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 0.5
        order = rng.permutation(train_at)
        for i in range(0, len(order), batch):
            some = order[i:i + batch]
            v = np.stack([xs[j][1] @ e[xs[j][0]] for j in some])
            z = v @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            dv = p @ w.T
            w -= 0.05 * lr * v.T @ p / len(some)
            b -= 0.05 * lr * p.mean(axis=0)
            for j, d in zip(some, dv):
                e[xs[j][0]] -= lr / len(some) * xs[j][1][:, None] * d
    table = e @ w
    z = np.stack([xs[j][1] @ table[xs[j][0]] for j in range(len(rows))]) + b
    check = np.flatnonzero(held) if held.sum() >= 10 else np.arange(len(rows))

    def loss(t):
        q = z[check] / t
        q = q - q.max(axis=1, keepdims=True)
        return -(q[np.arange(len(check)), y[check]] - np.log(np.exp(q).sum(axis=1))).mean()

    temperature = min(np.exp(np.linspace(np.log(0.05), np.log(20), 60)), key=loss)
    q = np.exp(z[check] / temperature - (z[check] / temperature).max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    top, right = q.max(axis=1), q.argmax(axis=1) == y[check]
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
    least = float(top[order[good[-1]]]) if len(good) else 1.0
    return LanguageModel(languages, table.astype(np.float32), b, float(temperature), least)


def fit(docs: DataFrame, admitted, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    return train(training_rows(docs, admitted, sample_rows))


def identify(docs: DataFrame, model: LanguageModel, reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    kind = StructType([StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    names = np.array(model.languages, object)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(1).to_pylist()
                lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                for a, b in _parts(texts):
                    p = model.probabilities(texts[a:b])
                    lang[a:b], score[a:b] = names[p.argmax(axis=1)], p.max(axis=1)
                for j, t in enumerate(texts):
                    if not t or not _LETTER.search(t) or reject and score[j] < model.least_score or lang[j] == "und":
                        lang[j], score[j] = "und", 0.0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=kind.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def admitted_rows(doc_id):
    return crc_fold(doc_id, 4) != 2
