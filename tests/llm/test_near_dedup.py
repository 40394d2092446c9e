"""Near duplicates against brute force: all pairs of full shingle sets."""

from __future__ import annotations

import random
import re
from itertools import combinations

from orograph.llm import near_dedup

SCHEMA = "doc_id long, text string, root string, n long"


def brute(rows):
    """{doc_id: (n_shingles, component_id)} by comparing every pair."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def got(spark, rows):
    out = near_dedup.near_duplicates(spark.createDataFrame([(*r, "root", 1) for r in rows], SCHEMA)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return out


def family(rng, words, copies, edits):
    """Copies of one text with a number of words replaced in each."""
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(copies):
        text = list(base)
        for i in rng.sample(range(len(text)), rng.choice(edits)):
            text[i] = rng.choice(words)
        yield " ".join(text)


def test_families_around_the_threshold(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = [t for _ in range(4) for t in family(rng, words, 30, [0, 1, 2, 3, 4, 5, 6, 8])]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{passage} " + " ".join(rng.choice(words) for _ in range(rng.choice([15, 20, 40, 80]))) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, rows)} == brute(rows)


def test_one_large_family_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = list(enumerate(family(rng, words, 150, [1, 2, 3, 4, 5, 6, 7, 9, 12])))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, rows)} == brute(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "é É a b c"), (8, "é é a b c")]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, rows)} == brute(rows)
    repeated = got(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")])
    assert sorted((r.doc_id or 0, r.component_id) for r in repeated) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    assert got(spark, []) == []
