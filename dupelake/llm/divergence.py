"""Divergence of the sources of a language from one another, by sparse merges of sorted (term id, count) arrays.

1. ``term_counts``: tasks count terms per (lang, source) in a dictionary of bounded size that is emptied into rows; one shuffle by
   (lang, term) adds the counts up, and the documents of a term decide whether its language keeps it.
2. ``sparse_arrays``: kept terms are dealt to buckets of about ``BUCKET_TERMS`` terms of a language. Inside a bucket a term's id is
   its rank, and a group's part is one array sorted by id. Every group has a row in every bucket, empty or not.
3. ``pair_values``: sources are dealt to blocks of ``BLOCK`` sources, and a task is an unordered pair of blocks in one bucket: the
   co-grouped arrays of both sides meet, each unordered pair of groups once. The ids of the shorter array are looked up in the
   longer one (galloping, so a short array does not read the long one through); overlaps, terms of one side alone and terms of
   neither are priced in both directions. Sums over buckets are whole numbers, so the result does not depend on the dealing.

A share is p = 1 + floor(10^9 (c + 1) / (N + V)); all arithmetic is on whole numbers (the division runs in three steps of three
digits, so counts up to 9 * 10^15 are exact, and sums stay in 64 bits up to 10^9 kept terms).

Defined cases: null text, lang or source is ''; a group without kept terms has the share of an absent term for every term; a
language without kept terms has value 0 for every pair; repeated rows count as documents of their own; an empty table gives no
rows; further columns, also those named like columns of the result, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, own_folder, slices, small_side, utf8_views, write_and_reread

SCALE = 1_000_000_000
#: A term is kept by a language if at least so many of its documents hold it.
LEAST_DOCUMENTS = 3
#: About so many kept terms of a language share a bucket.
BUCKET_TERMS = 1 << 16
#: Sources of one block of the pair tasks.
BLOCK = 8
#: Ranks of the terms of a group.
TOP_TERMS = 200
#: A task empties its counts into rows at so many entries.
MOST_ENTRIES = 1 << 20

#: Bytes of terms: A-Z in lower case, a-z and everything above ASCII; all other bytes separate terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, occurrences, documents) of a task; a group's term may come in several rows."""
    names = ["lang", "source", "term", "n", "docs"]
    held: dict[tuple, dict[bytes, list]] = defaultdict(dict)
    entries = 0

    def rows():
        for (lang, source), terms in held.items():
            keys = list(terms)
            for a in range(0, len(keys), 1 << 16):
                part = keys[a:a + (1 << 16)]
                n, docs = zip(*map(terms.__getitem__, part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                     pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=names)

    for batch in batches:
        data, offs = utf8_views(batch.column(2))
        groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for a, b in slices(offs):
            text = data[offs[a]:offs[b]].tobytes().translate(_TERM_BYTES)
            for i in range(a, b):
                terms = held[groups[i]]
                before = len(terms)
                once: dict[bytes, int] = {}
                for term in text[offs[i] - offs[a]:offs[i + 1] - offs[a]].split():
                    once[term] = once.get(term, 0) + 1
                for term, n in once.items():
                    have = terms.get(term)
                    if have is None:
                        terms[term] = [n, 1]
                    else:
                        have[0] += n
                        have[1] += 1
                entries += len(terms) - before
                if entries >= MOST_ENTRIES:
                    yield from rows()
                    held.clear()
                    entries = 0
    yield from rows()


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, n_lang, lead of every term that its language keeps: occurrences in the group and in the language, and
    whether this is the term's first row."""
    term = Window.partitionBy("lang", "term")
    return (_documents(docs).mapInArrow(_count_terms, COUNTS)
            .repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .withColumns({"n_lang": F.sum("n").over(term), "docs": F.sum("docs").over(term), "lead": F.col("source") == F.min("source").over(term)})
            .where(F.col("docs") >= least_documents).select("lang", "source", "term", "n", "n_lang", "lead"))


def group_sizes(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, source, total, lang_total, n_terms of every occurring group; one row per group."""
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("n_terms"))
    return (_documents(docs).select("lang", "source").distinct()
            .join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "lang_total", "n_terms"]))


def share(count, whole):
    """1 + floor(10^9 count / whole) of long columns, three digits at a time."""
    count, whole = (F.col(c) if isinstance(c, str) else c for c in (count, whole))
    rest, digits = count, F.lit(0).cast("long")
    for _ in range(3):
        digits = digits * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return digits + 1


def divergence(p, q):
    """floor((p - q)^2 / q) of long columns."""
    return F.call_function("div", (p - q) * (p - q), q)


def top_terms(counts: DataFrame, groups: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group uses more than its language does, at most ``most`` per group.

    The limit on ranks goes into the window, so a hot group sends ``most`` rows of each task and no more.
    """
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (counts.join(small_side(groups), ["lang", "source"])
            .withColumn("p", share(F.col("n") + 1, F.col("total") + F.col("n_terms")))
            .withColumn("q", share(F.col("n_lang") + 1, F.col("lang_total") + F.col("n_terms")))
            .where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most))


def sparse_arrays(counts: DataFrame, groups: DataFrame, bucket_terms: int = BUCKET_TERMS) -> DataFrame:
    """lang, bucket, source, total, n_terms, ids, n: the sorted array of every group in every bucket of its language."""
    sized = groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_terms") / bucket_terms)).cast("int"))
    buckets = small_side(sized.groupBy("lang").agg(F.first("buckets").alias("buckets")))
    placed = counts.join(buckets, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets").cast("int"))
    held = (placed.repartition("lang", "bucket")
            .withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy("term")))
            .groupBy("lang", "bucket", "source").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("held")))
    every = sized.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    return (every.join(held, ["lang", "bucket", "source"], "left")
            .select("lang", "bucket", "source", "total", "n_terms", F.coalesce("held.id", F.array().cast("array<int>")).alias("ids"),
                    F.coalesce("held.n", F.array().cast("array<bigint>")).alias("n")))


def shares(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), three digits at a time."""
    rest, digits = count.astype(np.int64) + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // whole
        rest = rest % whole
    return digits + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common ids of two sorted arrays of distinct ids, found by binary search of the shorter one's ids."""
    if len(short) > len(long):
        b, a = gallop(long, short)
        return a, b
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    a = np.flatnonzero(long[at] == short)
    return a, at[a]


class _Side:
    """A group's part in a bucket: ids, shares, and the share of an absent term."""

    def __init__(self, source, total, n_terms, ids, n):
        whole = max(1, int(total) + int(n_terms))
        self.source, self.ids, self.p = source, np.asarray(ids, np.int64), shares(np.asarray(n, np.int64), whole)
        self.none = int(shares(np.zeros(1, np.int64), whole)[0])


def _price(p, q) -> int:
    d = p - q
    return int((d * d // q).sum())


def merge(x: _Side, y: _Side) -> tuple[int, int, int]:
    """(x priced against y, y priced against x, terms of either) over the terms that x or y has in the bucket."""
    a, b = gallop(x.ids, y.ids)
    mine, theirs = np.ones(len(x.ids), bool), np.ones(len(y.ids), bool)
    mine[a] = theirs[b] = False
    both_x, both_y, only_x, only_y = x.p[a], y.p[b], x.p[mine], y.p[theirs]
    there = _price(both_x, both_y) + _price(only_x, y.none) + _price(np.int64(x.none), only_y)
    back = _price(both_y, both_x) + _price(np.int64(y.none), only_x) + _price(only_y, x.none)
    return there, back, len(x.ids) + len(y.ids) - len(a)


PRICES = "lang string, source string, item string, value long, seen long"


def _pair_task(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    sides = [[_Side(*row) for row in frame[["source", "total", "n_terms", "ids", "n"]].itertuples(index=False, name=None)] for frame in (left, right)]
    rows = []
    for x in sides[0]:
        for y in sides[1]:
            if key[2] != key[3] or x.source < y.source:
                there, back, seen = merge(x, y)
                rows += [(key[0], x.source, y.source, there, seen), (key[0], y.source, x.source, back, seen)]
    return pd.DataFrame(rows, columns=["lang", "source", "item", "value", "seen"])


def pair_values(arrays: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    blocks = groups.select("lang", "source", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / block).cast("int").alias("block"))
    blocks = blocks.withColumn("last", F.max("block").over(Window.partitionBy("lang")))
    placed = arrays.join(small_side(blocks), ["lang", "source"])
    task = ["lang", "bucket", "one", "two"]
    first = placed.withColumn("one", F.col("block")).withColumn("two", F.explode(F.sequence("block", "last")))
    second = placed.withColumn("two", F.col("block")).withColumn("one", F.explode(F.sequence(F.lit(0), F.col("block"))))
    second = second.select(*(F.col(c).alias(c) for c in second.columns))  # columns of its own beside those of the first side
    priced = first.groupBy(*task).cogroup(second.groupBy(*task)).applyInPandas(_pair_task, PRICES)
    absent = groups.select("lang", "source", "n_terms", share(F.lit(1).cast("long"), F.greatest(F.lit(1), F.col("total") + F.col("n_terms"))).alias("p"))
    p, q = (small_side(absent.select("lang", F.col("source").alias(at), F.col("p").alias(name), *more))
            for at, name, more in (("source", "p", ["n_terms"]), ("item", "q", [])))
    return (priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
            .join(p, ["lang", "source"]).join(q, ["lang", "item"])
            .select("lang", "source", "item", F.when(F.col("n_terms") == 0, 0).otherwise(
                F.col("value") + (F.col("n_terms") - F.col("seen")) * divergence(F.col("p"), F.col("q"))).alias("value")))


def audit(docs: DataFrame, most: int = TOP_TERMS, bucket_terms: int = BUCKET_TERMS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of a group from every other source and its most unusual terms."""
    folder = own_folder(docs.sparkSession, "divergence")
    counts = write_and_reread(term_counts(docs), f"{folder}/counts")
    groups = materialise(group_sizes(docs, counts))
    arrays = write_and_reread(sparse_arrays(counts, groups, bucket_terms), f"{folder}/arrays")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(arrays, groups, block).withColumn("rank", F.row_number().over(order))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(cols)
            .unionByName(top_terms(counts, groups, most).withColumn("part", F.lit("term")).select(cols)))


#: ``audit`` with its own parameters.
ORACLE_SQL = r"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms,
    row_number() over () as row from documents),
occ as (select lang, source, row, unnest(terms) term from d),
kept as (select lang, term, count(*) n from occ group by lang, term having count(distinct row) >= 3),
c as (select o.lang, o.source, o.term, count(*) n from occ o join kept k on o.lang = k.lang and o.term = k.term group by 1, 2, 3),
g as (select distinct lang, source from d),
v as (select lang, count(*) v, sum(n) n from kept group by lang),
t as (select lang, source, sum(n) n from c group by lang, source),
p as (select g.lang, g.source, k.term, k.n lang_n, coalesce(c.n, 0) c,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + v.v)::hugeint p
    from g join kept k on k.lang = g.lang join v on v.lang = g.lang
    left join t on t.lang = g.lang and t.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) val
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
every as (select a.lang, a.source, b.source item, coalesce(x.val, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source),
q as (select p.lang, p.source, p.term item, p.p, 1 + (1000000000::hugeint * (p.lang_n + 1)) // (v.n + v.v)::hugeint q
    from p join v on v.lang = p.lang where p.c > 0),
terms as (select lang, source, item, (((p - q) * (p - q)) // q)::bigint as value from q where p > q)
select lang, source, 'pair' part, item, value, cast(row_number() over (partition by lang, source order by value desc, encode(item)) as int) "rank" from every
union all
select lang, source, 'term' part, item, value, cast(row_number() over (partition by lang, source order by value desc, encode(item)) as int) "rank" from terms
qualify "rank" <= 200
"""
