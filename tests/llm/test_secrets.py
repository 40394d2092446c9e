"""The CRF of the secret scan: gradients, spans, planted secrets outside the patterns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.llm import secret_scan as scan


def test_gradients_are_the_likelihoods():
    rng = np.random.default_rng(3)
    sizes = {v: scan.WORDS if t is None else len(t) for v, t in scan.VIEWS.items()}
    codes = {v: rng.integers(0, n, (4, 6)) for v, n in sizes.items()}
    tags = rng.integers(0, 3, (4, 6))
    tags[1, 4:] = -1
    weights, moves = rng.normal(size=(scan.N_FEATURES, 3)), rng.normal(size=(3, 3))
    _, by_weight, by_move = scan.likelihood(weights, moves, codes, tags)
    step = 1e-5

    def value(w, m):
        return scan.likelihood(w, m, codes, tags)[0]

    for f in rng.permutation(np.flatnonzero(np.abs(by_weight).sum(1)))[:25]:
        for k in range(3):
            change = np.zeros_like(weights)
            change[f, k] = step
            assert (value(weights + change, moves) - value(weights - change, moves)) / (2 * step) == pytest.approx(by_weight[f, k], abs=1e-4)
    for i in range(3):
        for j in range(3):
            change = np.zeros((3, 3))
            change[i, j] = step
            assert (value(weights, moves + change) - value(weights, moves - change)) / (2 * step) == pytest.approx(by_move[i, j], abs=1e-4)


def test_spans_against_a_plain_version():
    rng = random.Random(2)
    for _ in range(200):
        bits = ['token = "abcd1234efgh"', "0af" * 12, "é漢😀", "AKIA" + "A" * 13, "word", "secret:xxxxxxxxxxxx"]
        text = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        data = text.encode()
        edges = sorted(rng.sample([len(text[:i].encode()) for i in range(len(text) + 1)], min(4, len(text)) & ~1))
        tagged = list(zip(edges[::2], edges[1::2], strict=True))
        base, both = scan.all_spans(data, tagged)
        points = [(len(data[:a].decode()), len(data[:b].decode())) for a, b in tagged]
        extra = [(a, b, "crf") for a, b in points if not any(x < b and a < y for x, y, _ in base)]
        assert base == scan.base_spans(text) and both == scan.ordered(base + extra)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
DECOYS = ["https://host.example/a/b12?id=77", "first.last22@mail7.example", "4111111111111111", "192.168.10.21", "2024-05-01T10:22:33Z", "+44-20-7946-0958", "getUserName2", "snake_case_name_1", "3.14159265358979", "v1.20.3-rc4"]


def planted(rng: random.Random) -> tuple[str, str]:
    made = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    lead, secret = rng.choice([("", "ghp_" + made(36)), ("", "sk_live_" + made(24)), ("Bearer ", made(40)), ("passwd - ", made(9) + "!" + made(8)), ("use ", "xoxb-" + made(36))])
    return lead, secret


def test_planted_secrets_outside_the_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = scan.train(docs)
    rng, rows, wanted = random.Random(5), [], {}
    for r in docs.where("length(text) between 100 and 4000").orderBy("doc_id").limit(400).collect():
        words = r.text.split(" ")
        for decoy in rng.sample(DECOYS, 2):
            words.insert(rng.randrange(len(words)), decoy)
        at = rng.randrange(1, len(words))
        lead, secret = planted(rng)
        start = len(" ".join(words[:at])) + 1 + len(lead)
        words.insert(at, lead + secret)
        rows.append((r.doc_id, " ".join(words)))
        wanted[r.doc_id] = start, start + len(secret)
    out = scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").withColumn("likely", F.lit("x")), crf).collect()
    texts, hit, wrong = dict(rows), 0, 0
    for r in out:
        a, b = wanted[r.doc_id]
        assert not any(x <= a < y for x, y, _ in scan.base_spans(texts[r.doc_id]))
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("crf")]
        hit += any(x <= a and b <= y for x, y in spans)
        wrong += sum(not (x < b and a < y) for x, y in spans)
    print(f"recall {hit / len(rows):.3f}, precision {hit / max(1, hit + wrong):.3f}")
    assert hit >= 0.8 * len(rows) and hit >= 0.95 * (hit + wrong)


def test_tags_are_the_best_path():
    rng = np.random.default_rng(8)
    for _ in range(20):
        crf = scan.Crf(rng.normal(size=(scan.N_FEATURES, 3)), rng.normal(size=(3, 3)))
        scores, which = rng.normal(size=(40, 3)) * 3, np.repeat([0, 1], 20)
        scores[:, scan.OUT] += 3
        assert crf.tags(which, scores).tolist() == crf.viterbi(scores[:20]) + crf.viterbi(scores[20:])
