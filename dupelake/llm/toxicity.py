"""Toxicity by weak supervision.

1. Lexicon: words and word beginnings whose document frequency among labelled training rows speaks for the toxic class, with a
   lists of plain insults, contempt, threats and phrases besides; scripts without blanks give pairs and triples of characters. Only rows that ``training`` admits are read for this, at most ``sample_rows`` of them.
2. Voters: every text gets one vote (1, 0 abstains, -1) of each lexicon and pattern. Patterns read the whole text: phrases, entries
   with swapped signs, marks or blanks between their letters or with letters repeated, entries inside words run together,
   shouting, rows of marks and address. Vote patterns are counted over ALL documents, which leaves at most 2 to the 12 times 9 rows.
3. Label model: expectation maximisation over the counted patterns estimates each voter's accuracy per class; voters that agree
   more than the classes explain are correlated and share their weight.
4. Classifier: a logistic regression over hit counts, rates and text statistics is trained on the posterior labels of the
   training sample, and its scores are calibrated on the labels of that sample; it scores every whole text.

Defined cases: null and empty texts are scored from zero features; a table without labels falls back to the insult list with
the prior ``base_rate``; rows with a null id are scored and never train; repeated rows get equal scores; an empty table gives
no rows; further columns are kept out of the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .common import crc_fold

#: Separate lexicons of plain words, and phrases (fixed values).
INSULTS = ("idiot", "moron", "stupid", "loser", "clown", "dumb", "imbecile", "jerk", "fool", "freak", "creep", "pig", "bastard")
CONTEMPT = ("trash", "scum", "pathetic", "worthless", "disgusting", "filth", "vermin", "garbage", "ugly")
THREATS = ("hate", "kill")
PHRASES = ("shut up", "go to hell", "drop dead", "piece of trash", "piece of garbage", "nobody likes you", "waste of space", "i hate you", "kill yourself",
           "kill you")
#: Words of address.
ADDRESS = frozenset("you your yours yourself yourselves you're youre u ur".split())
BEGINNINGS = (4, 5, 6, 7)
#: Labelled training rows read at most, and lexicon entries kept at most.
SAMPLE_ROWS, MOST_ENTRIES = 20_000, 1_500
THRESHOLD = 0.7
#: An entry needs this share of the toxic training rows (five at least), and this share of its rows toxic.
LEAST_SHARE, PRECISION = 0.006, 0.85


@dataclass
class Lexicon:
    """Learned words and word beginnings with their log odds, and the insults."""

    words: dict[str, float]
    beginnings: dict[str, float]
    base_rate: float = 0.1
    starts: frozenset[str] = frozenset()  # the first characters of every entry
    joined: re.Pattern | None = None  # entries that are looked for inside long runs of letters

    def __post_init__(self):
        plain = {*self.words, *FIXED}
        self.starts = frozenset(e[:4] for e in (*plain, *self.beginnings))
        self.joined = re.compile("|".join(re.escape(e) for e in sorted((e for e in plain if len(e) >= 5), key=lambda e: (-len(e), e))))

    def find(self, word: str) -> tuple[list[bool], float]:
        """Hits among words, beginnings and the fixed lexicons, and the largest log odds."""
        odds = [self.beginnings[word[:n]] for n in BEGINNINGS if word[:n] in self.beginnings]
        as_word, kind = self.words.get(word), FIXED.get(word, -1)
        return [as_word is not None, bool(odds), *(kind == i for i in range(N_FIXED))], max([as_word or 0.0, *odds, 1.0 if kind >= 0 else 0.0])

    def plain(self, word: str) -> bool:
        """Whether a word is an entry as it is, not by its beginning."""
        return word in self.words or word in FIXED


#: Word -> number of its fixed lexicon.
FIXED = {w: i for i, part in enumerate((INSULTS, CONTEMPT, THREATS)) for w in part}
N_FIXED = 3
#: Marks at the ends of a word.
_MARKS = ".,;:!?\"'()[]{}<>|/\\*#$%&@-_=+~`^«»“”„¿¡…0123456789"


#: Marks that end a word and stand for no letter, signs that stand for letters, and marks put between letters.
_ENDS = ".,;:!?\"'()[]{}<>«»“”„¿¡…"
_SWAP = str.maketrans({"0": "o", "1": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g", "|": "l",
                       **dict.fromkeys(".,;:-_*~'\"`/\\#=^\u00b7\u200b\u200c\u200d\u00ad")})
_MASKED = re.compile(r"[#$%&*@!]{3,}|[a-z][#$%&*@]{2,}")
_THRICE = re.compile(r"([^\W\d_])\1\1+")
_LETTERS = tuple(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")
_PHRASES = {p: re.compile(rf"(?<!\w){p}(?!\w)") for p in PHRASES}
#: Scripts that are written without blanks.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]{2,}")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Letters in a row that may be words run together.
LONG_WORD = 15


def unspaced(text: str | None) -> Counter:
    """Pairs and triples of characters of the scripts without blanks, and their counts."""
    out: Counter = Counter()
    if text and not text.isascii():
        for m in _UNSPACED.finditer(text):
            run = m[0]
            out.update(run[i:i + n] for n in (2, 3) for i in range(len(run) - n + 1))
    return out


def disguised(raw: str, lex: "Lexicon") -> str | None:
    """The entry that a spelling with swapped signs or marks between its letters stands for."""
    core = raw.strip(_ENDS)
    if core.isalpha():
        return None
    word = core.translate(_SWAP)
    return word if word != core and lex.plain(word) else None


def spread(words: list[str], lex: "Lexicon") -> list[str]:
    """Entries whose letters stand apart: runs of words of one letter."""
    out, run = [], ""
    for w in (*words, "--"):
        c = w.strip(_ENDS) if len(w) <= 2 else ""
        if len(c) == 1:
            run += c
        elif run:
            if len(run) > 2:
                out += _inside(run.translate(_SWAP), lex)
            run = ""
    return out


def _inside(run: str, lex: "Lexicon") -> list[str]:
    return [run] if lex.plain(run) else lex.joined.findall(run)


def word_counts(text: str | None) -> Counter:
    """Lower-case runs without white space and their counts; marks at the ends are still on."""
    return Counter((text or "").lower().split())


def grams(text: str | None) -> set[str]:
    """Distinct words and word beginnings of a text."""
    out = {w.strip(_MARKS) for w in word_counts(text)}
    out.discard("")
    pieces = unspaced(text)
    for n in BEGINNINGS:
        out |= {w[:n] + "*" for w in out if len(w) >= n and w[-1] != "*"}
    return out | set(pieces)


def _as_arrow(fn, schema: StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [(f.name, _ARROW[f.dataType.simpleString()]) for f in schema]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                cols = fn(*(c.to_pylist() for c in b.slice(i, 256).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kind)], names=schema.names)

    return run


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def training_sample(docs: DataFrame, labels: DataFrame, label: str, admitted, sample_rows: int) -> DataFrame:
    """text, y of at most ``sample_rows`` admitted labelled rows, those with the least hash of their id; the bound makes the
    broadcast of their ids safe."""
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & admitted(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.select("text", F.col("__y").alias("y")).where(F.col("text").isNotNull())


def learn_lexicon(sample: DataFrame, most: int = MOST_ENTRIES, least_share: float = LEAST_SHARE, precision: float = PRECISION) -> Lexicon:
    """Entries with the strongest smoothed log odds for the toxic class."""
    rows = StructType([StructField("gram", StringType()), StructField("y", IntegerType())])

    def fn(texts, ys):
        pairs = [(g, y) for t, y in zip(texts, ys) for g in sorted(grams(t))]
        return list(zip(*pairs)) if pairs else ([], [])

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = max(1, totals.get(1, 0)), max(1, totals.get(0, 0))
    counted = (sample.mapInArrow(_as_arrow(fn, rows), rows).groupBy("gram")
               .agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    best = (counted.where((F.col("p") >= max(5, least_share * pos)) & (F.col("p") >= precision * (F.col("p") + F.col("n"))))
            .select("gram", odds.alias("w")).orderBy(F.desc("w"), "gram").limit(most).collect())
    rate = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.1
    return Lexicon({r["gram"]: float(r["w"]) for r in best if not r["gram"].endswith("*")},
                   {r["gram"][:-1]: float(r["w"]) for r in best if r["gram"].endswith("*")}, min(0.5, max(0.02, rate)))


#: Voters for evidence: words, beginnings, the fixed lexicons, phrases, disguised and joined words, several kinds, any hit, hit rate;
#: voters for manner: shouting, rows of marks, address. The label model starts from the evidence.
N_EVIDENCE = 2 + N_FIXED + 3 + 3
N_VOTERS = N_EVIDENCE + 3


def measure(text: str | None, lex: Lexicon) -> tuple[np.ndarray, tuple[int, ...]]:
    """(features, votes) of one text."""
    hits, kinds, weight, n = [0] * (2 + N_FIXED), 0, 0.0, 0
    total, starts = 0, lex.starts
    odd, joined, masked, address, single = 0, 0, 0, 0, 0
    text = text or ""
    low = text.lower()
    seen = low.split()

    def take(word: str, times: int) -> bool:
        nonlocal hits, total, kinds, weight
        found, odds = lex.find(word)
        if not any(found):
            return False
        hits = [h + times * f for h, f in zip(hits, found)]
        total += times
        kinds += 1
        weight += odds
        return True

    thrice = any(c in low for c in _LETTERS)
    for raw, times in Counter(seen).items():
        n += times
        w = raw.strip(_MARKS)
        if w[:4] in starts and take(w, times):
            continue
        if w in ADDRESS:
            address += times
        if len(w) < 2:
            single += times
        if len(w) >= LONG_WORD:
            for e in set(lex.joined.findall(w)):
                joined += times
                take(e, times)
        if not raw.isalpha() and not raw.strip(_ENDS).isalpha():
            if word := disguised(raw, lex):
                odd += times
                take(word, times)
            elif _MASKED.search(raw):
                masked += times
        elif thrice and _THRICE.search(w):
            for word in (_THRICE.sub(r"\1", w), _THRICE.sub(r"\1\1", w)):
                if lex.plain(word):
                    odd += times
                    take(word, times)
                    break
    if single >= 3:
        for word in spread(seen, lex):
            odd += 1
            take(word, 1)
    for piece, times in unspaced(text).items():
        if piece in lex.words:
            take(piece, times)
    flat = " ".join(seen)
    phrases = sum(len(_PHRASES[p].findall(flat)) for p in PHRASES if p in flat)
    hits[2] += phrases  # an insult of several words
    total += phrases
    kinds += min(phrases, 1)
    weight += phrases
    rate = total / max(1, n)
    raw_bytes = text.encode("ascii", "ignore")
    upper, lower = len(raw_bytes) - len(raw_bytes.translate(None, _UPPER)), len(raw_bytes) - len(raw_bytes.translate(None, _LOWER))
    shouted = upper / (upper + lower) if upper + lower >= 10 else 0.0
    marks = text.count("!!") + text.count("??") + text.count("?!") + text.count("!?") + masked
    manner = (1 if shouted > 0.5 else 0, 1 if marks > 0.002 * n else 0, 1 if address > 0.02 * n else 0)
    x = np.array([*np.log1p(hits), np.log1p(total), np.log1p(kinds), min(weight, 60.0) / 10, min(1.0, 20 * rate), *(1.0 if h else 0.0 for h in hits),
                  1.0 if total else 0.0, 1.0 if kinds > 1 else 0.0, np.log1p(n) / 10, np.log1p(phrases), np.log1p(odd), np.log1p(joined), *manner,
                  shouted, min(1.0, 20 * marks / max(1, n)), min(1.0, 10 * address / max(1, n))])
    votes = (*(1 if h else 0 for h in (*hits, phrases, odd, joined)), 1 if kinds > 1 else 0, 1 if total else -1,
             1 if rate > 0.002 else (-1 if rate < 0.0005 else 0), *manner)
    return x, votes


@dataclass
class LabelModel:
    """P(vote | class) of every voter, the class prior and the voters' weights."""

    prior: float
    table: np.ndarray  # voter x class x vote + 1
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ll = np.zeros((len(votes), 2)) + np.log([1 - self.prior, self.prior])
        for j in range(votes.shape[1]):
            ll += self.weight[j] * np.log(self.table[j][:, votes[:, j] + 1]).T
        ll -= ll.max(axis=1, keepdims=True)
        p = np.exp(ll)
        return p[:, 1] / p.sum(axis=1)


def fit_label_model(votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60, lead: int | None = None) -> LabelModel:
    """Expectation maximisation over counted vote patterns, started from the balance of votes of the first ``lead`` voters."""
    n_voters = votes.shape[1]
    balance = votes[:, :lead].sum(axis=1)
    q = np.where(balance > 0, 0.9, np.where(balance < 0, 0.05, prior))
    model = LabelModel(prior, np.full((n_voters, 2, 3), 1 / 3), np.ones(n_voters), np.eye(n_voters))
    total = counts.sum()
    for step in range(rounds):
        mass = np.stack((counts * (1 - q), counts * q))
        for j in range(n_voters):
            for c in (0, 1):
                got = np.bincount(votes[:, j] + 1, mass[c], 3) + 0.5
                model.table[j, c] = got / got.sum()
        model.prior = float(np.clip(mass[1].sum() / max(total, 1), 0.005, 0.6))
        if step == 0:  # what the balance of votes leaves unexplained is correlation; later rounds would explain it as class
            centred = votes - np.einsum("jcv,v,cn->nj", model.table, [-1, 0, 1], np.stack((1 - q, q)))
            cov = (centred * counts[:, None]).T @ centred / max(total, 1)
            sd = np.sqrt(np.diag(cov)) + 1e-9
            model.correlation = cov / sd[:, None] / sd[None]
            model.weight = 1 / np.maximum(1, np.abs(np.where(np.abs(model.correlation) > 0.1, model.correlation, 0)).sum(axis=1))
        q = model.posterior(votes)
    return model


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a logistic regression on soft labels, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1]) * l2
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a / len(a) + ridge, a.T @ (p - y) / len(a) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function of the score that fits the labels best, as ends of its steps and their rates."""
    at, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    hits = np.bincount(inverse, y)
    steps: list[list[float]] = []  # first score, last score, rows, hits
    for s, m, h in zip(at, n, hits):
        steps.append([s, s, m, h])
        while len(steps) > 1 and steps[-2][3] * steps[-1][2] >= steps[-1][3] * steps[-2][2]:
            _, last, m2, h2 = steps.pop()
            steps[-1][1:] = [last, steps[-1][2] + m2, steps[-1][3] + h2]
    rates = [(h + 0.5 * y.mean()) / (m + 0.5) for _, _, m, h in steps]
    return np.array([e for s in steps for e in s[:2]]), np.maximum.accumulate(np.repeat(rates, 2))


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    label_model: LabelModel
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # a trace of the raw score keeps the order inside a step
        return raw if self.knots is None else 0.99 * np.interp(raw, *self.knots) + 0.01 * raw


def fit(docs: DataFrame, labels: DataFrame, admitted, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """``admitted`` maps a doc_id column to the condition under which a labelled row may be learnt from."""
    sample = training_sample(docs, labels, "toxic", admitted, sample_rows)
    lex = learn_lexicon(sample)
    kind = StructType([StructField("votes", StringType())])

    def vote(texts):
        return ([",".join(map(str, measure(t, lex)[1])) for t in texts],)

    patterns = docs.select("text").mapInArrow(_as_arrow(vote, kind), kind).groupBy("votes").agg(F.count("*").alias("n")).collect()
    votes = np.array([[int(v) for v in r["votes"].split(",")] for r in patterns] or [[0] * N_VOTERS])
    model = fit_label_model(votes, np.array([float(r["n"]) for r in patterns] or [1.0]), lex.base_rate, lead=N_EVIDENCE)
    row = StructType([StructField("x", ArrayType(DoubleType())), StructField("p", DoubleType()), StructField("y", IntegerType())])

    def soft(texts, ys):
        got = [measure(t, lex) for t in texts]
        return [list(x) for x, _ in got], [float(p) for p in model.posterior(np.array([v for _, v in got]))] if got else [], ys

    rows = sample.mapInArrow(_as_arrow(soft, row), row).collect()  # at most sample_rows short vectors
    if rows:
        x, p, y = np.array([r["x"] for r in rows]), np.array([r["p"] for r in rows]), np.array([float(r["y"]) for r in rows])
        order = np.lexsort((y, p, *x.T))  # the same model whatever order the rows arrive in
        x, p, y = x[order], p[order], y[order]
    else:
        got = [measure(" ".join(INSULTS[:i]), lex) for i in range(4)]
        x, y = np.array([g[0] for g in got]), None
        p = model.posterior(np.array([g[1] for g in got]))
    out = ToxicityModel(lex, model, *fit_logistic(x, p))
    if y is not None and 0 < y.mean() < 1:
        # correlated voters leave the posterior right in order but shy in size
        out.knots = isotonic(out.raw(x), y)
    return out


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with the further column ``toxic_score``."""
    text_at = docs.columns.index("text")
    out = StructType([*(f for f in docs.schema if f.name != "toxic_score"), StructField("toxic_score", DoubleType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, min(1024, b.num_rows - i))
                x = np.array([measure(t.as_py(), model.lexicon)[0] for t in part.column(text_at)])
                cols = [c for c, n in zip(part.columns, part.schema.names) if n != "toxic_score"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(model.score(x), pa.float64())], names=out.names)

    return docs.mapInArrow(run, out)


def admitted_rows(doc_id):
    return crc_fold(doc_id, 3) != 1


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, admitted=admitted_rows) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    scored = score(docs, fit(docs, labels, admitted))
    return scored.where(F.col("toxic_score") < threshold).select(*docs.columns)
