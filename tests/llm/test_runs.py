"""Runs with a period: brute force, contract of the planted periods, odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from orograph.llm import periodic_runs


def brute(words: list, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing words a period apart, for every period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, 2 * q):
                stretch = words[i : i + length]
                if not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(rng: random.Random) -> list[list[int]]:
    out = []
    for _ in range(rng.randrange(1, 6)):
        n, block = rng.randrange(60), [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 12))]
        kinds = ([rng.randrange(2) for _ in range(n)], [0] * n, [block[i % len(block)] for i in range(n)], (block * 4 + [8, 7]) * 3)
        text = list(rng.choice(kinds))
        if text and rng.random() < 0.5:
            text[rng.randrange(len(text))] = 5
        out.append(text)
    return out


def test_equals_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        texts, shortest = _texts(rng), rng.choice([2, 5, 12])
        found = periodic_runs.find_runs(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64), shortest=shortest)
        got = [[] for _ in texts]
        for k, *run in zip(*(c.tolist() for c in found), strict=True):
            got[k].append(tuple(run))
        assert got == [brute(t, shortest) for t in texts]


def test_texts_beyond_packed_numbers(monkeypatch):
    rng = random.Random(4)
    texts = [t for _ in range(40) for t in _texts(rng)]
    args = np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64)
    packed = periodic_runs.find_runs(*args, shortest=2)
    monkeypatch.setattr(periodic_runs, "_LOW", 3)
    plain = periodic_runs.find_runs(*args, shortest=2)
    assert all((a == b).all() for a, b in zip(packed, plain, strict=True)) and len(packed[0])


def wanted(doc_id: int | None, text: str | None) -> tuple:
    """The contract's row, word by word."""
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def _found(docs, **options):
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs), **options))


def test_documents_and_odd_rows(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 9000]
    rows += [(1, None), (2, ""), (3, " \t\n\x0b"), (None, "a b " * 9), (None, "a b " * 9), (7, "a b " * 9), (7, "a b " * 9), (15, "x"), (16, "é ß 漢字 " * 7), (17, "a\x1cb " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "words", "n", "g", "h", "a", "p", "best", "collapsed")})
    for options in ({}, {"batch_words": 50}):
        assert sorted(map(str, map(tuple, _found(docs, **options).collect()))) == sorted(str(wanted(*r)) for r in rows)


def test_no_documents(spark):
    assert _found(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_of_one_word(spark):
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([(1, "word " * 20_000)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 20_000, 1)] and row.collapsed == "word" and row.n_words == 20_000
