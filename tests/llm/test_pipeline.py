"""The pipeline's stages, each against a plain version on what its predecessor kept."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from test_near_dedup import brute

import corpus_pipeline
from orograph.llm import decontamination, quality


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {"documents": [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]}
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    sets = {k: Counter(v) for k, v in kept.items()}
    assert sets["quality_classifier"] == Counter(r for r in kept["documents"] if model.score((r[1] or "").encode()) >= 0.3)
    roots = brute([r[:2] for r in kept["quality_classifier"]])
    assert sets["minhash_near_dedup"] == Counter(r for r in kept["quality_classifier"] if roots[r[0]][1] == r[0])
    items = [decontamination.fold(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = lambda t: any(decontamination.best_match(i, t)[0] <= int(0.05 * len(i)) for i in items if i)
    assert sets["benchmark_decontamination"] == Counter(r for r in kept["minhash_near_dedup"] if not leaks(decontamination.fold(r[1])))
    assert sets["mix_sources"] == sets["shard_mix"] == sets["benchmark_decontamination"]
    placed = docs.orderBy("shard", "slot").collect()
    assert [r.doc_id for r in placed] == [r[0] for r in kept["mix_sources"]]  # shards keep the mix's order
    totals = Counter()
    for r in placed:
        totals[r.shard] += r.size
    assert max(totals.values()) - sum(totals.values()) / 16 <= max(r.size for r in placed)


def _stage_input(spark, tmp_path, name, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], schema).withColumns({c: F.lit("x") for c in ("row", "size", "shard", "position", "component_id", "_path")})
    for k, part in enumerate(("one", "two")):  # the same file names in two folders
        half = docs.where(f"pmod(xxhash64(doc_id, text, source), 2) = {k}")
        half.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / name / part))
    return spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / name))


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    item, other, third = prose(30), prose(40), prose(40)
    near = other.split()
    near[0] = "changed"
    rows = [(1, None, "a"), (2, "", None), (3, "   ", "a"), (4, "one", "b"), (4, "one", "b"), (None, "one", "b")]
    rows += [(5, other, "a"), (5, third, "a"), (6, "x " + item + " y", "a"), (6, prose(35), "a"), (None, item, None), (None, prose(33), "a"), (8, " ".join(near), "a"), (9, "word " * 30000, "b")]
    bench = tmp_path / "tables"
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(bench / "benchmark.parquet"))
    spark.createDataFrame([(4, 1), (9, 1)], "doc_id long, quality int").write.parquet(str(bench / "labels.parquet"))
    docs = _stage_input(spark, tmp_path, "odd", rows)
    got = {name: Counter((r.doc_id, r.text, r.source) for r in stage(spark, docs, str(bench)).collect()) for name, stage in corpus_pipeline.STAGES}
    assert got["quality_classifier"] == got["mix_sources"] == got["shard_mix"] == Counter(rows)
    one = Counter([(4, "one", "b")])
    assert got["minhash_near_dedup"] == Counter(r for r in rows if r[1] not in ("one", item) and r[0] != 8) + one  # (6, "x ... y") is near the bare item
    assert got["benchmark_decontamination"] == Counter(r for r in rows if not r[1] or item not in r[1])
    empty = _stage_input(spark, tmp_path, "none", [(1, "a", "a")]).where("doc_id is null")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(bench)).count() == 0, name
