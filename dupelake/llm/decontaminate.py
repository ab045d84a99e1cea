"""Benchmark decontamination with spaced-seed hashing, in DataFrame functions only.

A seed mask is a string of 1 and 0; a window of tokens is hashed over its 1 positions, so tokens under a 0 may differ.
A bitmap of fixed size passes the training windows that may match; training and benchmark windows join on the hash, which
includes the mask; every hit names a diagonal (training position less item position).
On the diagonal all tokens of the item are compared, and an overlap is a stretch of ``stretch`` aligned tokens (the whole
item if it is shorter) of which at least ``share`` are equal. Where the given masks miss an allowed arrangement of unequal tokens
(items of 1 to 8, 10 and 11 tokens) the items of that length have masks of their own, over the whole stretch, that miss none.

Defined cases: null or empty texts have no tokens and no overlaps; rows with a null id or item id take no part; repeated
rows give one result; an item of a few tokens overlaps every place that holds them; further columns of either table are ignored.
The twin of ``oracle_sql`` seeds with the given masks alone and so lacks the overlaps of those lengths that they miss.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, materialise, small_side, without

#: Five of eight positions each; any two masks share at most three positions.
MASKS = ("11100101", "11010011", "10111100")
STRETCH = 13
SHARE = 0.8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _misses(n: int, faults: int, masks: tuple[str, ...]) -> bool:
    """Whether some choice of ``faults`` unequal positions among ``n`` leaves no mask at any place with equal tokens alone."""
    places = [[j + i for i, c in enumerate(m) if c == "1"] for m in masks for j in range(n - len(m) + 1)]
    if faults > 6:
        return True  # not worked out

    def hit(left: list[list[int]], more: int) -> bool:
        return not left or more > 0 and any(hit([x for x in left if at not in x], more - 1) for at in left[0])

    return hit(places, faults)


def _own_masks(n: int, faults: int) -> tuple[str, ...]:
    """Masks over ``n`` tokens, one of which holds no unequal position, wherever ``faults`` of them are: the positions are cut into
    two parts more than there are faults, and every choice of ``faults`` parts is left out once."""
    parts = 1 if faults <= 0 else min(n, faults + 2)
    return tuple("".join("0" if i * parts // n in out else "1" for i in range(n)) for out in combinations(range(parts), min(parts, max(faults, 0))))


def masks_of(n: int, masks: tuple[str, ...] = MASKS, share: float = SHARE) -> tuple[str, ...]:
    """The masks that find every stretch of ``n`` tokens with ``share`` of them equal: ``masks``, or own ones where those miss any."""
    faults = n - math.ceil(n * share - 1e-9)
    return _own_masks(n, faults) if _misses(n, faults, masks) else masks


def _seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, str]], admit=None, wide: str | None = None) -> DataFrame:
    """One row per token position and mask: ``keep``, pos (from 0), seed. A mask comes with the number under which it is hashed;
    ``admit`` maps a seed to whether it is wanted; ``wide`` is a column with the numbers of the masks a row takes part in."""
    least, span = min(len(m) for _, m in masks), max(len(m) for _, m in masks)
    # windows of token hashes: an array of structs of longs is several times cheaper to lay out in rows than one of strings
    rows = rows.select(*keep, *([wide] if wide else []), F.transform("toks", lambda t: F.xxhash64(t)).alias("hs"))
    shifted = [F.slice("hs", F.lit(j + 1), F.greatest(F.size("hs") - least + 1, F.lit(0))).alias(f"t{j}") for j in range(span)]
    also = [wide] if wide else []
    at = rows.select(*keep, *also, F.arrays_zip(*shifted).alias("win")).select(*keep, *also, F.posexplode("win").alias("pos", "w"))

    def seed(m: int, mask: str) -> Column:
        s = F.xxhash64(F.lit(m), *[F.col("w")[f"t{j}"] for j, c in enumerate(mask) if c == "1"])
        if len(mask) > least:  # the window may pass the end of the text
            s = F.when(F.col("w")[f"t{len(mask) - 1}"].isNotNull(), s)
        return F.when(F.array_contains(wide, m), s) if wide else s

    at = at.select(*keep, "pos", *[seed(m, mask).alias(f"s{m}") for m, mask in masks])
    if admit is not None:
        wanted = F.lit(False)
        for m, _ in masks:
            wanted = wanted | admit(F.col(f"s{m}"))
        at = at.where(wanted)
    return at.select(*keep, "pos", F.explode(F.array(*[f"s{m}" for m, _ in masks])).alias("seed")).where(F.col("seed").isNotNull())


#: Longs of the seed bitmap, whatever the size of the benchmark: 128 KB.
BITMAP = 16_384


def _bitmap_test(seeds: DataFrame):
    """A test that admits every seed of ``seeds`` and few others, by a bitmap of fixed size in a scalar subquery."""
    bit = F.pmod("seed", F.lit(BITMAP * 64))
    ones = seeds.select(F.floor(bit / 64).cast("int").alias("word"), F.expr("shiftleft(bigint(1), int(pmod(seed, 64)))").alias("bits"))
    zeros = seeds.sparkSession.range(BITMAP).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    whole = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.transform("all", lambda x: x["bits"]).alias("bitmap"))
    bitmap = materialise(whole).scalar()

    def admit(seed: Column) -> Column:
        word = F.get(bitmap, F.shiftrightunsigned(F.pmod(seed, F.lit(BITMAP * 64)), 6).cast("int"))
        return F.getbit(word, F.pmod(seed, F.lit(64)).cast("int")) == 1

    return admit


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, stretch: int = STRETCH, share: float = SHARE,
             broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Verified overlaps: doc_id, item_id, doc_start, item_start, n_tokens (aligned), n_equal; one row per diagonal."""
    items = (benchmark.where(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("toks")).distinct()
             .withColumn("item_n", F.size("toks")).withColumn("item_key", F.xxhash64("toks")))
    # items have the masks of their length; only the lengths that occur cost windows of the documents
    widths = sorted(r["w"] for r in items.where(F.col("item_n") > 0).select(F.least(F.lit(stretch), F.col("item_n")).alias("w")).distinct().collect())
    taken = {n: masks_of(n, masks, share) for n in widths}
    every = list(enumerate(dict.fromkeys([m for n in widths for m in taken[n]]))) or list(enumerate(masks))
    number = {m: i for i, m in every}
    numbers = F.array().cast("array<int>")
    for n in widths:
        numbers = F.when(F.least(F.lit(stretch), F.col("item_n")) == n, F.array(*[F.lit(number[m]) for m in taken[n]])).otherwise(numbers)
    seeds = materialise(_seeds(items.withColumn("numbers", numbers), ["item_id", "item_key", "item_n"], every, wide="numbers").withColumnRenamed("pos", "item_pos"))
    few = seeds.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", tokens(F.col("text")).alias("toks"))
    hits = _seeds(texts, ["doc_id"], every, _bitmap_test(seeds)).join(F.broadcast(seeds) if few else seeds, "seed")
    hits = materialise(hits.select("doc_id", "item_id", "item_key", "item_n", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    # the tokens of documents with hits cross an exchange, so that they are cut once per document and not once per hit
    again = texts.join(small_side(hits.select("doc_id").distinct()), "doc_id", "left_semi").distinct()
    found = again.join(hits.hint("shuffle_merge"), "doc_id").select(
        "doc_id", "item_id", "item_key", "shift",
        F.slice("toks", F.greatest("shift", F.lit(0)) + 1, F.col("item_n") + F.least("shift", F.lit(0))).alias("seen"))
    item_side = items.select("item_id", "item_key", F.col("toks").alias("item_toks"))
    pairs = found.join(F.broadcast(item_side) if few else item_side, ["item_id", "item_key"])
    skip = F.greatest(-F.col("shift"), F.lit(0))
    pairs = pairs.withColumn("item_start", skip).withColumn("doc_start", F.greatest("shift", F.lit(0)).cast("long")) \
        .withColumn("equal", F.zip_with("seen", F.expr("slice(item_toks, item_start + 1, size(seen))"), lambda a, b: F.when(a == b, 1).otherwise(0)))
    w = F.least(F.lit(stretch), F.size("item_toks"))
    need = F.ceil(w * F.lit(share) - F.lit(1e-9)).cast("int")
    pairs = pairs.withColumn("w", w).withColumn("need", need).where(F.size("equal") >= F.col("w"))
    dense = F.exists(F.sequence(F.lit(1), F.greatest(F.size("equal") - F.col("w") + 1, F.lit(1))),
                     lambda i: F.aggregate(F.slice("equal", i, F.col("w")), F.lit(0), lambda a, x: a + x) >= F.col("need"))
    return pairs.where(dense).select(
        "doc_id", "item_id", "doc_start", F.col("item_start").cast("long"), F.size("equal").cast("long").alias("n_tokens"),
        F.aggregate("equal", F.lit(0), lambda a, x: a + x).cast("long").alias("n_equal")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that have a verified overlap; rows with a null id stay."""
    return without(docs, overlaps(docs, benchmark, **settings))


def oracle_sql(masks: tuple[str, ...] = MASKS, stretch: int = STRETCH, share: float = SHARE) -> str:
    """The same rows in DuckDB, with the seed windows joined as lists of tokens."""
    span = max(map(len, masks))
    toks = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    key = lambda m: "[" + ", ".join(f"toks[p + {j + 1}]" for j, c in enumerate(m) if c == "1") + "]"
    seeds = lambda t, cols: " UNION ALL ".join(
        f"SELECT {cols}, p, {i} AS mask, {key(m)} AS seed FROM (SELECT *, unnest(range(0, len(toks) - {span - 1})) AS p FROM {t} WHERE len(toks) >= {span})"
        for i, m in enumerate(masks))
    return f"""
WITH d AS (SELECT DISTINCT doc_id, {toks} AS toks FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, {toks} AS toks FROM benchmark WHERE item_id IS NOT NULL),
ds AS ({seeds('d', 'doc_id, toks')}), bs AS ({seeds('b', 'item_id, toks')}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.toks AS dt, bs.toks AS bt, ds.p - bs.p AS shift FROM ds JOIN bs USING (mask, seed)),
al AS (SELECT doc_id, item_id, shift, greatest(-shift, 0) AS item_start, greatest(shift, 0) AS doc_start, least({stretch}, len(bt)) AS w,
  [CASE WHEN dt[i + shift] = bt[i] THEN 1 ELSE 0 END FOR i IN range(1, len(bt) + 1) IF i + shift >= 1 AND i + shift <= len(dt)] AS eq FROM hits)
SELECT DISTINCT doc_id, item_id, CAST(doc_start AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start,
 CAST(len(eq) AS BIGINT) AS n_tokens, CAST(list_sum(eq) AS BIGINT) AS n_equal
FROM al WHERE len(eq) >= w AND len([i FOR i IN range(1, len(eq) - w + 2) IF list_sum(eq[i:i + w - 1]) >= ceil(w * {share} - 1e-9)]) > 0
"""
