"""Line dedup, n-gram join, decontamination and byte-string dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from dupelake.llm import byte_dedup, bwt, components, decontaminate, lines, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **extra):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("pos", "node", "gram", "toks", "seed", "covered", "h", "chunk", "label", "w", "a", "b", "equal"):
        df = df.selectExpr("*", f"'x' AS {name}")  # further columns with clashing names
    return df


def prose(r, n, vocabulary=60):
    return " ".join(r.choice(WORDS[:vocabulary]) for _ in range(n))


WORDS = [f"w{i}" for i in range(400)]


def near_copies(seed):
    """Random texts, copies, chains of near copies, a hot line, and the odd cases."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 60), 400) for _ in range(25)]
    base = prose(r, 90, 400).split()
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
        base = w if r.random() < 0.2 else base
    hot = prose(r, 12, 400)
    texts += [hot + "\n" + prose(r, r.randint(5, 30), 400) for _ in range(20)]
    texts += [texts[3]] * 5 + [None, "", "   \t\n", "One", "one two", "ONE TWO", "é à ü one"] + [texts[0] + " end", texts[0].upper()]
    r.shuffle(texts)
    return list(enumerate(texts)) + [(0, texts[0]), (None, "nameless text"), (None, None)]


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                if sets[i] != sets[j]:
                    links.add(frozenset((sets[i], sets[j])))
    least = collections.defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        root = find(i)
        if d is not None and (least[root] is None or d < least[root]):
            least[root] = d
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)], len(links)


def keyed(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("seed,k,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_ngram_join(spark, seed, k, percent):
    rows = near_copies(seed)
    docs = frame(spark, rows)
    want, links = brute_components(rows, k, percent)
    got = [tuple(r) for r in ngram_join.join_components(docs, k, percent).select("doc_id", "n_shingles", "component_id").collect()]
    assert keyed(got) == keyed(want)
    assert ngram_join.similar_pairs(docs, k, percent).count() == links > 0
    kept = ngram_join.keep_representatives(docs, k, percent)
    assert kept.columns == docs.columns
    drop = {d for d, _, c in want if d is not None and d != c}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(d for d, _ in rows if d is not None and d not in drop)


def test_ngram_join_empty(spark):
    assert ngram_join.join_components(frame(spark, []).limit(0), 3, 90).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def line_texts(seed):
    r = random.Random(seed)
    pool = [f"line {i}" for i in range(30)]
    texts = ["\n".join(r.choice(pool[:12]) if r.random() < .3 else f"own {r.random()}" for _ in range(r.randint(1, 15))) for _ in range(40)]
    block = "\n".join(pool[:5])
    texts += [f"x{i}\n{block}\ny{i}" for i in range(20)] + [block, block, "", None, "a\n\n\n\n\nb", "a\n\n\n\n\nb", "q\nq\nq\nq\nq\nq"]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = line_texts(seed)
    seen, want = set(), []
    for i, t in rows:
        ls, gone = (t or "").split("\n"), set()
        for p in range(len(ls) - 2 if t is not None else 0):
            key = tuple(ls[p:p + 3])
            gone |= {p, p + 1, p + 2} if key in seen else set()
            seen.add(key)
        want.append((i, len(ls) if t is not None else 0, len(gone), None if t is None else "\n".join(x for p, x in enumerate(ls) if p not in gone)))
    docs = frame(spark, rows)
    assert keyed(map(tuple, lines.dedup_report(docs).collect())) == keyed(want)
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns
    assert keyed((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == keyed(
        (i, t, len(t or "")) for (i, n, g, t) in want if not (g and g == n))
    twice = frame(spark, rows + rows[:10])
    assert twice.count() - lines.dedup_lines(twice, keep_empty=True).count() == 0
    assert lines.dedup_lines(docs.limit(0)).count() == 0
    nameless = frame(spark, [(None, "a\nb\nc\nd"), (None, "a\nb\nc\nd"), (1, "a\nb\nc")])
    assert sorted(r.text for r in lines.dedup_lines(nameless).collect()) == ["a\nb\nc", "a\nb\nc\nd", "a\nb\nc\nd"]


def bench_case(seed):
    r = random.Random(seed)
    items = [(i, prose(r, r.randint(8, 40), 400)) for i in range(12)] + [(50, None), (51, "too short"), (None, prose(r, 20, 400)), (3, prose(r, 20, 400))]
    texts = [prose(r, r.randint(3, 80), 400) for _ in range(30)]
    for i, t in items[:12]:
        w = t.split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(prose(r, 10, 400) + " " + " ".join(w).upper() + ", " + prose(r, 10, 400))
        texts.append(" ".join(w[: len(w) // 2]))
    texts += [items[0][1], None, "", "!!!"]
    return list(enumerate(texts)) + [(0, texts[0]), (None, items[1][1])], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination(spark, seed):
    rows, items = bench_case(seed)
    docs = frame(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS pos", "'y' AS toks")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for d, t in rows:
        for i, b in items:
            dt, bt = words(t), words(b)
            if d is None or i is None:
                continue
            hits = {p - q for m in decontaminate.MASKS for p in range(len(dt) - 7) for q in range(len(bt) - 7)
                    if all(dt[p + j] == bt[q + j] for j, c in enumerate(m) if c == "1")}
            for s in hits:
                at = [(q + s, q) for q in range(len(bt)) if 0 <= q + s < len(dt)]
                eq = [dt[p] == bt[q] for p, q in at]
                w = min(decontaminate.STRETCH, len(bt))
                if len(eq) >= w and any(sum(eq[x:x + w]) >= decontaminate.SHARE * w - 1e-9 for x in range(len(eq) - w + 1)):
                    want.add((d, i, max(s, 0), max(-s, 0), len(eq), sum(eq)))
    got = [tuple(r) for r in decontaminate.overlaps(docs, bench).collect()]
    assert keyed(got) == keyed(want) and want
    assert keyed(tuple(r) for r in decontaminate.overlaps(docs, bench, broadcast_rows=1).collect()) == keyed(want)  # shuffled join
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d, _ in rows if d not in {x[0] for x in want})
    assert decontaminate.overlaps(docs.limit(0), bench).count() == decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_decontamination_twin(spark):
    rows, items = bench_case(9)
    rows = [x for x in rows if x[0] is not None]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", items)
    want = con.execute(decontaminate.oracle_sql()).fetchall()
    got = decontaminate.overlaps(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert keyed(tuple(r) for r in got.select("doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal").collect()) == keyed(want)


def test_decontamination_of_short_items(spark):
    r = random.Random(5)
    items = [(n, " ".join(r.choice("abcdefghijklmnop") + str(n) for _ in range(n))) for n in range(1, 15)] + [(20, ""), (21, "x y")]
    rows = [(1000, "x y"), (1001, "x"), (1002, "z x y")]
    for n, b in items[:14]:
        w, toks = min(13, n), b.split()
        faults = w - -(-8 * w // 10)
        for out in itertools.combinations(range(w), faults):
            got = ["?%d" % i if i in out else t for i, t in enumerate(toks)]
            got = [t.replace("?", "new") for t in got]
            rows.append((len(rows), " ".join((["pre"] if len(rows) % 2 else []) + got + (["post"] if len(rows) % 3 else []))))
        rows.append((len(rows), " ".join("new" if i <= faults else t for i, t in enumerate(toks[:w]))))
    want = set()
    for d, t in rows:
        for i, b in items:
            dt, bt = t.split(), b.split()
            w = min(13, len(bt))
            for s in range(-len(bt) + 1, len(dt)):  # every diagonal, without seeds
                eq = [dt[q + s] == bt[q] for q in range(len(bt)) if 0 <= q + s < len(dt)]
                if w and len(eq) >= w and any(sum(eq[x:x + w]) >= 0.8 * w - 1e-9 for x in range(len(eq) - w + 1)):
                    want.add((d, i, max(s, 0), max(-s, 0), len(eq), sum(eq)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.overlaps(frame(spark, rows), bench).collect()]
    assert keyed(got) == keyed(want) and {i for _, i, *_ in want} == {*range(1, 15), 21}
    assert [decontaminate.masks_of(n) == decontaminate.MASKS for n in range(1, 14)] == [n in (9, 12, 13) for n in range(1, 14)]


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms(seed):
    r = random.Random(seed)
    base = bytes(r.choice(b"ab ") for _ in range(120))
    width, depth = r.choice([2, 3]), r.choice([2, 4])
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) + base[(x := r.randint(0, 60)):x + r.randint(0, 40)] for _ in range(r.randint(1, 12))]
    own = np.array([r.randint(0, 9) for _ in texts])
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = bwt.least_owner(np.frombuffer(b"".join(texts), np.uint8), offs, own, width, depth, r.choice([1, 2, 5]))
    n, low = width * depth, {}
    for t, o in zip(texts, own):
        for p in range(len(t) - n + 1):
            low[t[p:p + n]] = min(o, low.get(t[p:p + n], 99))
    assert got.tolist() == [low[t[p:p + n]] if p + n <= len(t) else o for t, o in zip(texts, own) for p in range(len(t))]


def byte_texts(seed):
    r = random.Random(seed)
    letters = "abcdeé ß"
    rand = lambda n: "".join(r.choice(letters) for _ in range(n))
    shared = [rand(r.choice([40, 49, 50, 51, 70, 200])) for _ in range(6)]
    texts = []
    for _ in range(40):
        texts.append("".join(rand(r.randint(0, 60)) + r.choice(shared)[r.randint(0, 8):] for _ in range(r.randint(0, 4))))
    texts += [texts[1], texts[1], "", None, "a" * 300, "a" * 120, "short", "short"]
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, True), (4, True)])
def test_byte_dedup(spark, seed, hot, monkeypatch):
    if hot:  # frequent minimizers and their salts on a small table
        for name, value in (("PILOT", 1), ("PILOT_HITS", 2), ("SALT_ROWS", 3)):
            monkeypatch.setattr(byte_dedup, name, value)
    rows = byte_texts(seed)
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p:p + 50], d)
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 49):
            if first[raw[p:p + 50]] < d:
                gone[p:p + 50] = [True] * 50
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    rows = rows + rows[2:4] + [(None, rows[0][1] or "x" * 60)]
    want = want + want[2:4] + [(None, len((rows[0][1] or "x" * 60).encode()), 0, 0, hashlib.sha256((rows[0][1] or "x" * 60).encode()).hexdigest())]
    docs = frame(spark, rows)
    assert keyed(map(tuple, byte_dedup.remove_repeats(docs).collect())) == keyed(want)
    assert sum(w[2] for w in want) > 500
    assert byte_dedup.remove_repeats(docs.limit(0)).count() == 0
