"""Token files, conversation repair and source divergence against brute force."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from dupelake.llm import conversations, divergence, token_store

DOCS = "doc_id long, text string, lang string, source string"


def invented(n, seed=3):
    r = random.Random(seed)
    parts = ["the", "Übung", "don't", "x,y;z", "12", "ΣΑΣ", "éte", "日本語", "a b", "\t", " ", "\x1c", "it's 's", "\U0001f600!", "ﬁ", "\r\n", "İ"]
    return [" ".join(r.choice(parts) for _ in range(r.choice([0, 1, 4, 60, 900]))) for _ in range(n)]


def test_words_give_the_ids_of_whole_texts():
    file = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = invented(60) + ["", " ", "\n\n a", "a <|endoftext|> b", "<|startoftext|>", " ́a", "a\ńb", "A" * 5000, "क़ क़, \u1e9e. K! Å; ŉ: ǅ, ﬃ. a, a. ,, .a b,. ŉ's", "x" + "́" * 300]
    r = random.Random(4)
    texts += ["".join(r.choices([*map(chr, range(1, 256)), *" ''aestlrvmd,."], k=200)) for _ in range(300)] + [chr(a) + "b" + chr(a) * 2 for a in range(256)]
    got = token_store.TextEncoder().many(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == file.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block_bytes", [64, 1 << 20])
def test_token_files(spark, tmp_path, block_bytes):
    texts = invented(150) + [None, "", "a <|endoftext|> b"]
    rows = [(i * 7 % 1009, t, None, None) for i, t in enumerate(texts)] + [(None, "no id", "en", "s"), (5, "twice", "en", "s"), (5, "twice", "en", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"start": F.lit("x"), "block": F.lit(None)}).repartition(5)
    path = token_store.write_tokens(docs, str(tmp_path / "t"), block_bytes=block_bytes)
    file = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append(file.encode(text or "", add_special_tokens=False).ids + [1])
    at, by_id = 0, collections.defaultdict(list)
    for r in sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        by_id[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert list(by_id) == sorted(by_id, key=lambda d: (d is not None, d))
    assert {d: sorted(v) for d, v in by_id.items()} == {
        d: sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in v) for d, v in want.items()}
    some = spark.createDataFrame([(0,), (5,), (7,), (99999,), (None,), (5,)], "doc_id long")
    got = collections.defaultdict(list)
    for r in token_store.read_documents(spark, path, some).collect():
        got[r.doc_id].append(r.ids)
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(want[d]) for d in (0, 5, 7)}
    assert token_store.read_index(spark, path).agg(F.countDistinct("block")).first()[0] >= (20 if block_bytes == 64 else 1)


def test_token_files_of_an_empty_table_and_a_wrong_dictionary(spark, tmp_path):
    path = token_store.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "e"))
    assert token_store.read_digests(spark, path).count() == 0
    one, _ = token_store.encode_block([b"abc", b""], b"A" * 32, 2)
    assert token_store.frames_of_block(one, b"A" * 32) == (2, [b"abc", b""])
    for broken in (one[:-1], b"XXXX" + one[4:]):
        with pytest.raises(ValueError):
            token_store.frames_of_block(broken, b"A" * 32)
    with pytest.raises(ValueError):
        token_store.frames_of_block(one, b"B" * 32)


def divergence_by_loops(rows, most):
    rows = [tuple(x or "" for x in r[1:]) for r in rows]  # text, lang, source
    df, n = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = {t for t, d in df[lang].items() if d >= 3}
        sources = sorted({r[2] for r in rows if r[1] == lang})
        count = {s: {t: n[lang, s][t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:limit])}
    return out


def test_source_divergence(spark):
    r = random.Random(5)
    words = [a + b for a in "abcdeé" for b in ["x", "Y", "zß", "9", "ö"]] + ["über", "I'll", "Ω"]
    rows = [(i, " ".join(r.choice(words[:5 + 5 * (i % 6)]) for _ in range(r.choice([0, 3, 40]))), r.choice(["en", "de", None]), f"s{i % 11}") for i in range(200)]
    rows += [(1, None, "en", "s1"), (2, "   ", "xx", None), (3, "once", "xx", "b"), (None, "ax " * 50, "en", None), (4, "ax", "en", "empty"), (4, "ax", "en", "empty")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"item": F.lit(1), "rank": F.lit(1), "n": F.lit(None)}).repartition(4)
    for block, bucket in ((2, 4), (8, 1 << 16)):
        got = divergence.audit(docs, most=7, bucket_terms=bucket, block=block)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, got.collect())) == sorted(divergence_by_loops(rows, 7))
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_of_large_counts(spark):
    pairs = [(1, 1), (1, 3), (7 * 10**14, 9 * 10**15), (9 * 10**15, 9 * 10**15), (123456789012, 987654321098765)]
    want = [1 + 10**9 * a // b for a, b in pairs]
    assert [int(divergence.shares(np.array([a - 1]), b)[0]) for a, b in pairs] == want
    got = spark.createDataFrame(pairs, "a long, b long").select(divergence.share("a", "b").alias("p")).collect()
    assert [x.p for x in got] == want


def test_galloping():
    r = random.Random(6)
    for _ in range(50):
        a, b = (np.array(sorted(r.sample(range(60), r.randrange(40))), np.int64) for _ in range(2))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def repaired_by_search(rows):
    """(cost, edit string, repaired lines) by trying everything, cheapest and then least first. Rows are (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    turn = (2, 2, 3, 2)
    while heap:
        cost, path, i, q, made = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, path, made
        if (path, i, q) in done:
            continue
        done.add((path, i, q))
        if path.count("I") < 3 + len(rows) and not path.endswith("III"):
            heapq.heappush(heap, (cost + 2, path + "I", i, turn[q], (*made, ("user:" if turn[q] == 2 else "assistant:"))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, path + "D", i + 1, q, made))
            if fault < 2:
                heapq.heappush(heap, (cost + 2 + fault, path + "R", i + 1, turn[q], (*made, ("user:" if turn[q] == 2 else "assistant:") + text)))
                if (role[:1], q) in step:
                    heapq.heappush(heap, (cost + fault, path + "K", i + 1, step[role[:1], q], (*made, role + ":" + text)))


def repaired_by_rules(rows):
    """Expected plan of a conversation's rows (turn, role, text, copies), without the damage."""
    rows = sorted(((t, r or " ", x or " ") for t, r, x, c in rows for _ in range(c)), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, faulty, count = set(), [], collections.Counter()
    for _, role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 3 if not ink else 2 if (role, text) in seen else 1 if ink[-1] not in ".!?" else 0
        seen.add((role, text))
        count[fault] += 1
        faulty.append((role, text, fault))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, path, made = repaired_by_search(faulty)
    return (gaps, count[3], count[2], count[1], illegal, cost, path, hashlib.sha256("\n".join(made).encode()).hexdigest()), made


def some_conversations(n, longest, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for _ in range(r.randrange(longest + 1)):
            rows.append((c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", "tool", "", None, "User", "ünd"]),
                         r.choice(["Yes.", "No!", "so", "", None, "\n \t", "a.b", "é?\n", "x" * 3000]), r.choice([0, 1, 1, 1, 1, 2])))
    return rows


@pytest.mark.parametrize("spill", [2, 1 << 20])
def test_conversation_repair(spark, spill):
    rows = some_conversations(70, 6, 8)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").withColumns({"gaps": F.lit("x"), "fault": F.lit(None)}).repartition(3)
    plans = conversations.plan_repairs(turns, spill)
    made = collections.defaultdict(list)
    for r in conversations.repaired_turns(turns, plans).collect():
        made[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    got = {r[0]: tuple(r[1:]) for r in plans.collect()}
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for c in ids:
        want, lines = repaired_by_rules([r[1:] for r in rows if r[0] == c])
        assert got[c] == want, c
        assert sorted(made[c]) == list(enumerate(lines))
    assert conversations.plan_repairs(turns.limit(0)).count() == 0


def test_damage_of_conversations(spark):
    rows = [(c, t, r, x) for c in (*range(40), None) for t in (None, 0, 1, 2) for r, x in (("assistant", "A. b? c!"),)] + [(7, 1, None, None)]
    got = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for (c, t, role, text), r in zip(rows, got):
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = text or " ", role or " "
        assert (r.role, r.text, r.copies) == ("user" if code == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text), {0: 0, 3: 2}.get(code, 1))


def test_a_giant_conversation_keeps_no_text():
    repair = conversations.Repair(conversations.Steps(), 1 << 12)
    for i in range(50_000):
        repair.add(i, ("user", "assistant")[i % 2], f"{i}.", 0)
    assert len(repair.back) * 2 < 1 << 12 and len(repair.steps.steps) < 50
    gaps, *_, cost, audit, digest = repair.close()
    lines = "\n".join(f"{('user', 'assistant')[i % 2]}:{i}." for i in range(50_000))
    assert (gaps, cost, audit, digest) == (0, 0, "K" * 50_000, hashlib.sha256(lines.encode()).hexdigest())
