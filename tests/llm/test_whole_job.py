"""Cases that an operator once left out."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import decontaminate, secrets
from tests.llm.test_operators import brute_leaks, brute_spans, docs, prose


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


# ---------------------------------------------------------------- op6_decontaminate


def edited(seed, delete=False):
    """An item with short words at both ends, and a text that holds it with words put in or left out."""
    r = random.Random(seed)
    n = r.randrange(30, 80)
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    item = [word(1 if i < 7 or i >= n - 7 else r.randrange(6, 13)) for i in range(n)]
    k, at = r.randrange(1, 6), r.randrange(n // 3, 2 * n // 3)
    body = item[:at] + item[at + k :] if delete else item[:at] + [word(1) for _ in range(k)] + item[at:]
    return " ".join(item), " ".join([word(6) for _ in range(10)] + body + [word(6) for _ in range(10)])


def test_windows_between_alignments(spark):
    pairs = [edited(s) for s in (170, 205, 251, 279, 297, 387)] + [edited(s, True) for s in range(4)]
    items, rows = [(i, a) for i, (a, _) in enumerate(pairs)], [(i, b) for i, (_, b) in enumerate(pairs)]
    want = brute_leaks(rows, items)
    assert {i for i, _ in want} >= set(range(6))  # no aligned window of these six is at 0.8
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs(spark, rows), benchmark(spark, items)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_random_edits(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice((1, 2, 3, 5, 8, 14))))
    items, rows = [], []
    for i in range(80):
        item = [word() for _ in range(r.randrange(20, 90))]
        text = list(item)
        for _ in range(r.randrange(0, 6)):
            at = r.randrange(len(text))
            text[at : at + r.randrange(0, 3)] = [word() for _ in range(r.randrange(0, 3))]
        items.append((i, " ".join(item)))
        rows.append((i, " ".join([*(word() for _ in range(r.randrange(0, 30))), *text, *(word() for _ in range(r.randrange(0, 30)))])))
    want = brute_leaks(rows, items)
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(docs(spark, rows), benchmark(spark, items)).collect()}
    assert len(want) >= 30 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_clean_keeps_rows_by_their_own_text(spark):
    item, other = prose(7, 40, 3000), prose(8, 60, 3000)
    rows = [(1, item), (1, other), (None, item), (None, other), (None, None), (2, other)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k1 string")
    kept = decontaminate.clean(df, benchmark(spark, [(0, item)]))
    assert kept.columns == df.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, other), (None, other), (None, None), (2, other)]))


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 1])
def test_rows_of_one_doc_id_are_searched_each(spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    item = prose(7, 40, 3000)
    start = " ".join(item.split()[:8])
    # the same doc_id, size and start: one text holds the item, the others only its first words
    clean = [f"{prose(9, 6)} {start} {prose(20 + i, 60)}" for i in range(6)]
    bad = f"{prose(9, 6)} {item} {prose(10, 20)}"
    rows = [(i, t) for i in (5, None) for t in (*clean[:3], bad, *clean[3:], bad)] + [(6, clean[0])]
    got = decontaminate.contaminated(docs(spark, rows, 1), benchmark(spark, [(0, item)])).collect()
    assert {(r.doc_id, r.item_id, r.similarity, r.start) for r in got} == {(5, 0, 1.0, 6), (None, 0, 1.0, 6)} and len(got) == 2
    once = decontaminate.contaminated(docs(spark, [(5, bad)]), benchmark(spark, [(0, item)])).first()
    assert {r.n_windows for r in got} == {once.n_windows}  # equal rows count once


# ---------------------------------------------------------------- op10_secrets


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
def test_keys_of_every_alphabet(spark, alphabet):
    r = random.Random(1)
    keys = ["".join(r.choice(alphabet) for _ in range(40)) for _ in range(20)]
    words = ["Donaudampfschifffahrtsgesellschaft", "internationalization_of_documents", "x" * 40]
    got = {x.doc_id: x.spans for x in secrets.scan(docs(spark, list(enumerate(keys + words)))).collect()}
    assert all([(s.start, s.kind, s.end) for s in got[i]] == [(0, 3, 40)] for i in range(20)) and not any(got[i] for i in range(20, 23))


def brute_entropy(text, width=secrets.WINDOW):
    """Every span of kind entropy, window by window."""
    h = lambda w: -sum(n / len(w) * math.log2(n / len(w)) for n in Counter(w).values())
    base, out = brute_spans(text), []
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        bits = next(b for _, p, b in secrets.CLASSES if re.search(p, s))
        if any(re.search(p, s) for p in secrets.ALLOW) or any(a <= m.start() and m.end() <= z for a, _, z in base):
            continue
        if max(h(s[i : i + width]) for i in range(len(s) - width + 1)) >= bits - 1e-9:
            out.append((m.start(), 3, m.end()))
    return out


def test_entropy_spans_are_those_of_brute_force(spark):
    r = random.Random(5)
    alphabets = ["0123456789abcdef", "abcdefghijklmnop", "ABCXYZ0189", "abcABC012+/_-=", "ab01", "x"]
    piece = lambda: "".join(r.choice(r.choice(alphabets)) for _ in range(r.choice((5, 19, 20, 21, 40, 127, 128, 129, 147, 148, 300))))
    one = lambda: (lambda a: "".join(r.choice(a) for _ in range(r.choice((19, 20, 33, 128, 148, 149, 260)))))(r.choice(alphabets))
    texts = [" ".join(r.choice((piece, one, lambda: "é word", lambda: f"token={one()}"))() for _ in range(12)) for _ in range(60)]
    texts += [" ".join(f"{i:032x}" for i in range(300)), "y" * 19 + "Q7kP2mX9vB4nL8sD1fGh" + "y" * 300, "A" * 200 + "Q7kP2mX9vB4nL8sD1fGh"]
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.spans] for x in secrets.scan(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: sorted(brute_spans(t) + brute_entropy(t)) for i, t in enumerate(texts)}
    assert sum(k == 3 for v in got.values() for _, k, _ in v) > 100


def test_a_million_characters(spark):
    r = random.Random(1)
    texts = {"random": "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=10**6)), "poor": "".join(r.choices("abAB0-", k=10**6)), "keys": " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000))}
    began = time.time()
    got = {x.doc_id: [(s.start, s.kind, s.end) for s in x.spans] for x in secrets.scan(docs(spark, list(enumerate(texts.values())))).collect()}
    assert time.time() - began < 100  # seconds here; growth with the square of the length would take hours
    assert got == {i: sorted(brute_spans(t) + ([(0, 3, 10**6)] if k == "random" else [])) for i, (k, t) in enumerate(texts.items())}


# ---------------------------------------------------------------- pipeline


def test_null_and_repeated_doc_ids(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 50)
    rows = [(None, a), (4, a), (4, a), (None, b), (4, c)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("4", a), ("None", b), ("4", c)])
    mixed = corpus_pipeline.mixture(spark, df, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in mixed) == sorted((str(i), t) for i, t in rows)
