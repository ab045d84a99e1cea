"""Quality classifier by a sparse rule ensemble.

Statistics of every text are Spark column expressions. On a bounded sample of labelled rows, shallow trees are grown one after
the other on what the trees before leave unexplained; every path from a root is a conjunctive rule. A lasso logistic regression
keeps few of the rules, and these are compiled into one Spark column expression, so scoring stays in the JVM.

Defined cases: null and empty texts have all statistics 0 and are scored; rows with a null id are scored and never train; without
labelled rows every score is 0.5; with one class only, the score is that class's rate; repeated rows get equal scores; an empty
table gives no rows; further columns are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_fold

THRESHOLD = 0.3
#: Labelled training rows read at most.
SAMPLE_ROWS = 10_000
TREES, DEPTH, LEAST_ROWS = 30, 3, 15


def statistics(text: Column) -> dict[str, Column]:
    """Name -> expression over a text without nulls."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda marks: (F.length(text) - F.length(F.translate(text, marks, ""))) / n
    words, rows = F.filter(F.split(text, "[ \\n\\t]+"), lambda w: w != ""), F.split(text, "\n")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "word_chars": F.when(F.length(text) > 0, n / n_words).otherwise(0.0),
        "distinct_words": F.when(F.length(text) > 0, F.size(F.array_distinct(words)) / n_words).otherwise(0.0),
        "log_words": F.log1p(F.size(words).cast("double")),
        "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"),
        "symbols": share("#$%&*^~<>{}[]|\\@=_+/"),
        "bars": share("|"),
        "shouts": share("!?"),
        "stops": share(".,;:"),
        "blanks": share(" "),
        "beyond_ascii": F.when(F.length(text) > 0, (F.octet_length(text) - F.length(text)) / n).otherwise(0.0),
        "line_chars": F.log1p(n / F.size(rows)),
        "distinct_lines": F.when(F.length(text) > 0, F.size(F.array_distinct(rows)) / F.size(rows)).otherwise(0.0),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics as one struct column ``__stats``."""
    named = docs.withColumn("__text", F.coalesce(F.col("text"), F.lit("")))
    return named.withColumn("__stats", F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col("__text")).items()])).drop("__text")


Rule = tuple[tuple[int, bool, float], ...]  # (feature, is above, cut), ...


def _best_split(x: np.ndarray, g: np.ndarray, rows: np.ndarray, features: np.ndarray) -> tuple[float, int, float] | None:
    best = None
    for f in features:
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        v, s = v[order], np.cumsum(g[rows][order])
        n = np.arange(1, len(v) + 1)
        ok = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= LEAST_ROWS) & (len(v) - n[:-1] >= LEAST_ROWS))
        if not len(ok):
            continue
        gain = s[ok] ** 2 / n[ok] + (s[-1] - s[ok]) ** 2 / (len(v) - n[ok])
        i = int(gain.argmax())
        if best is None or gain[i] > best[0]:
            best = (float(gain[i]), int(f), float((v[ok[i]] + v[ok[i] + 1]) / 2))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Distinct rules of boosted trees, each on half of the rows and most of the features."""
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-z))
        sample = np.sort(rng.permutation(len(y))[: max(2 * LEAST_ROWS, len(y) // 2)])
        features = rng.permutation(x.shape[1])[: max(2, 2 * x.shape[1] // 3)]
        todo = [((), sample, np.arange(len(y)))]
        while todo:
            path, rows, everyone = todo.pop()
            split = _best_split(x, g, rows, features) if len(path) < depth and len(rows) >= 2 * LEAST_ROWS else None
            if path:
                rules[path] = None
            if split is None:
                p = 1 / (1 + np.exp(-z[rows]))
                z[everyone] += 0.3 * g[rows].sum() / ((p * (1 - p)).sum() + 1.0)
                continue
            _, f, cut = split
            for above in (False, True):
                todo.append((path + ((f, above, cut),), rows[(x[rows, f] > cut) == above], everyone[(x[everyone, f] > cut) == above]))
    return list(rules)


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, above, cut in rule:
            out[:, j] *= (x[:, f] > cut) == above
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 800) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient steps; columns are weighed by their spread."""
    spread = np.maximum(a.std(axis=0), 1e-3)
    b = np.hstack((a / spread, np.ones((len(a), 1))))
    step = 4 * len(b) / max(np.linalg.norm(b, 2) ** 2, 1e-9)
    w = np.zeros(b.shape[1])
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        new = v - step * (b.T @ (1 / (1 + np.exp(-np.clip(b @ v, -30, 30))) - y)) / len(b)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[-1]), w[:-1] / spread


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self, stats: str = "__stats") -> Column:
        """The score as a Spark expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            hit = F.lit(True)
            for f, above, cut in rule:
                value = F.col(stats)[self.names[f]]
                hit = hit & ((value > cut) if above else (value <= cut))
            total = total + F.when(hit, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, admitted, sample_rows: int = SAMPLE_ROWS, penalty: float = 3e-3) -> RuleModel:
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & admitted(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("__y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")).select("__y", "__stats.*").collect()
    names = list(statistics(F.col("text")))
    if not rows:
        return RuleModel(names, [], [], 0.0)
    y = np.array([r["__y"] for r in rows], float)
    x = np.array([[r[n] for n in names] for r in rows], float)
    order = np.lexsort((y, *x.T))  # the same model whatever order the rows arrive in
    x, y = x[order], y[order]
    rules = grow_rules(x, y) if 0 < y.mean() < 1 else []
    if not rules:
        return RuleModel(names, [], [], float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    intercept, w = lasso_logistic(fires(rules, x), y, penalty)
    kept = [j for j in range(len(rules)) if abs(w[j]) > 1e-4]
    return RuleModel(names, [rules[j] for j in kept], [float(w[j]) for j in kept], intercept)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with the further column ``quality_score``."""
    return with_statistics(docs).withColumn("quality_score", model.column()).drop("__stats")


def admitted_rows(doc_id):
    return crc_fold(doc_id, 5) != 0
