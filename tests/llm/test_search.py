"""Lexical search: brute force, shards and rounds of any size, the order, odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from orograph.llm import lexical_search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[str]:
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs: list[tuple], items: list[tuple], k: int) -> Counter:
    held = [(d, Counter(t)) for d, text in docs if (t := terms(text))]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out: Counter = Counter()
    for item, text in items:
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out.update((item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1))
    return out


def frames(spark, docs, items):
    clash = {c: F.lit("x") for c in ("shard", "terms", "leaf", "n", "score", "rank", "query", "bound", "at", "term")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash), spark.createDataFrame(items, "item_id long, text string").withColumns(clash)


def test_ties_odd_rows_and_small_shards(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(1000 + i, "the same text Over and over, w1") for i in range(200)]  # one leaf, many shards
    docs += [(5, None), (6, ""), (7, "?!"), (None, "w1 w2 é漢"), (None, "w1 w2 é漢"), (8, "W1 W2 É漢"), (8, "W1 W2 É漢"), (9, "w2 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(None, "w1 w2 w2"), (1, "é漢"), (1, "é漢"), (3, None), (4, "..."), (5, "unknown"), (6, "over SAME")]
    found, asked = frames(spark, docs, items)
    wanted = brute(docs, items, 7)
    tree = lexical_search.fit_order(found, sample=100, depth=3)
    for options in ({"shard_docs": 16}, {"shard_docs": 1000, "shard_entries": 300}):
        index = lexical_search.build_index(found, tree=tree, **options)
        assert index.shards.count() > 10
        assert index.shards.select(F.explode("doc_ids")).count() == index.documents == len([d for d in docs if terms(d[1])])
        for search in ({"first": 1}, {"block_items": 4}):
            got = lexical_search.search(index, asked, k=7, **search).select("item_id", "rank", "doc_id", "score").collect()
            assert Counter(map(tuple, got)) == wanted


def test_nothing_to_find(spark):
    docs, items = frames(spark, [], [(1, "a")])
    assert lexical_search.search(lexical_search.build_index(docs), items).count() == 0
    docs, items = frames(spark, [(1, "a")], [])
    assert lexical_search.search(lexical_search.build_index(docs), items).count() == 0
    docs, items = frames(spark, [(1, "a")], [(1, "b")])
    assert lexical_search.search(lexical_search.build_index(docs), items).count() == 0


def test_bisection_brings_like_documents_together():
    rng = random.Random(7)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(4)]
    documents = [(k, sorted({*rng.sample(topics[k], 12), *rng.sample(["a", "b", "c", "d", "e"], 3)})) for _ in range(60) for k in range(4)]
    rng.shuffle(documents)
    tree = lexical_search.fit_tree([d for _, d in documents], depth=2)
    leaves: dict[int, Counter] = {}
    for k, _ in documents:
        fresh = sorted({*rng.sample(topics[k], 12), "a"})
        leaves.setdefault(tree.leaf(fresh), Counter())[k] += 1
    assert len(leaves) == 4 and sum(c.most_common(1)[0][1] for c in leaves.values()) >= 0.95 * len(documents)


def test_few_shards_are_visited(spark, monkeypatch):
    """With topics kept together, the bound ends the search before most shards were scored."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"t{i % 8}w{rng.randrange(30)}" for _ in range(20))) for i in range(800)]
    found, asked = frames(spark, docs, [(1, "t3w1 t3w2 t3w5"), (2, "t6w7 t6w9")])
    index = lexical_search.build_index(found, tree=lexical_search.fit_order(found, depth=3), shard_docs=50)
    shards, visits = index.shards.count(), []
    visit = lexical_search._visit
    monkeypatch.setattr(lexical_search, "_visit", lambda block, low, high, least: visits.append((low, high)) or visit(block, low, high, least))
    got = lexical_search.search(index, asked, k=5, first=1)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute(docs, [(1, "t3w1 t3w2 t3w5"), (2, "t6w7 t6w9")], 5)
    assert shards >= 12 and 1 <= len(visits) <= 3


def test_shards_are_read_one_at_once(spark, monkeypatch):
    """While a block is searched tasks hold one shard; what was set before holds afterwards, after an error too."""
    names, seen = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"], []
    settings = lambda: [spark.conf.get(n) for n in names]
    before, block = settings(), lexical_search._search_block
    monkeypatch.setattr(lexical_search, "_search_block", lambda *a: seen.append(settings()) or block(*a))
    docs, items = frames(spark, [(i, f"a b w{i}") for i in range(40)], [(1, "a w3"), (2, "w9")])
    index = lexical_search.build_index(docs, shard_docs=4)
    assert lexical_search.search(index, items, k=3).count() == 4 and seen == [["1", "1"]] and settings() == before
    monkeypatch.setattr(lexical_search, "_search_block", lambda *a: 1 / 0)
    try:
        lexical_search.search(index, items)
    except ZeroDivisionError:
        pass
    assert settings() == before
