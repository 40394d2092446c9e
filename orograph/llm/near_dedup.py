"""Near duplicates by bottom-k sketches of word shingles.

A document's set holds its distinct runs of five words, hashed to 64 bits; its
sketch holds the ``K`` smallest values, so one hash function serves all.

1. Documents with the same set form a class; the rest works on one node for
   each class, so copies are never expanded into pairs.
2. Inverted lists of the ``LISTED`` smallest values. In each list the nodes are
   paired with its first node; a node's most frequent such partner is verified.
   This joins most large groups with one pair for each node.
3. A list whose nodes are in one component is finished. For the nodes of the
   others the shingles that some other component also holds are counted on full
   sets. A link needs ``3 * (n + m) <= 7 * overlap``, so a node with too few of
   these for the smallest fitting partner in a list leaves that list: this is
   exact, and takes one row for each shingle however large the group is.
4. The nodes left are verified against a few of their lists' most typical nodes
   (whose shingles are most common), which joins the rest of most large groups.
5. Lists that still hold several components give all pairs between these, each
   in the list of its first common value only. The nodes outside a list's main
   component are dealt over bounded blocks of the list.
6. In a block the bottom-k of a pair's union estimates its similarity, which
   only drops pairs far below the threshold; full sets decide about the others.

Links are exact; a pair at the threshold is missed only if its sketches are
unlike beyond chance (under one in a million, see ``FLOOR`` and ``LISTED``).

Defined results: no words or null text: an empty set, linked with nothing; rows
that share a doc_id share that node's component; a null doc_id takes the
component of its set's other documents, or null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import discard, each_text, runs, scratch, small, utf8, word_hashes

#: Words in a shingle, values in a sketch, values with inverted lists.
WORDS, K, LISTED = 5, 256, 16
#: Nodes in a block of a list; typical nodes that a list names; of these, how many a node is verified against.
BLOCK, HEADS, TRIED = 256, 4, 3
#: Estimates below this are dropped; at a similarity of 0.75 that is over six standard deviations away.
FLOOR = 0.588
#: Open lists that a node must stand in; a linked one stands in about twelve of LISTED.
LEAST_LISTS = 3
#: Sizes are told apart in bands of this ratio; so many bands below lies the smallest partner.
BAND, BANDS_BELOW = 1.02, 15
#: Bits of the map that tells which documents' sets are needed.
_BITS = 1 << 23


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes (as signed 64-bit) of the text's runs of five words."""
    return np.unique(runs(word_hashes(text.lower().split()), WORDS).view(np.int64))


def _key(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, keys, low = [], [], []
        for text in each_text(b):
            s = shingles(text)
            sizes.append(len(s))
            keys.append(_key(s))
            low.append(s[:LISTED])
        made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(low, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", "n", "set_key", "low"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))


def _sets(needed: np.ndarray):
    """(node, values) of documents whose bit is set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = b.column("bit").to_numpy(zero_copy_only=False)
            chosen = np.flatnonzero(needed[bit >> 3] >> (bit & 7) & 1)
            sets = [shingles(b.column("text")[int(i)].as_py()) for i in chosen]
            made = [pa.array([_key(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(chosen)), *made], ["doc_id", "set_key", "values"])

    return run


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _likely(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sketches' sets may be similar enough: by the share of the union's smallest values that both hold.

    Sketches of fewer than K values are whole sets, of which the share is exact.
    """
    _, times = np.unique(np.concatenate([x, y]), return_counts=True)
    if len(x) < K and len(y) < K:
        return 100 * (times == 2).sum() >= 75 * len(times)
    return (times[:K] == 2).mean() >= FLOOR


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of a list's blocks of askers and members that may be linked; a pair only in the list of its first common value."""
    for b in batches:
        found = []
        for v, ask, members in zip(b.column("v").to_pylist(), b.column("ask"), b.column("m"), strict=True):
            p, q = (dict(zip(("node", "root", "n", "s", "asks"), (x.values.field(i).to_numpy(zero_copy_only=False) for i in range(5)), strict=True)) for x in (ask, members))
            ps, qs = ([y.values.to_numpy() for y in x.values.field(5)] for x in (ask, members))
            listed = [frozenset(y[:LISTED].tolist()) for y in qs]
            for i, own in enumerate(ps):
                n, low = p["n"][i], frozenset(own[:LISTED].tolist())
                fits = (q["root"] != p["root"][i]) & (~q["asks"] | (q["node"] > p["node"][i])) & (100 * q["n"] >= 75 * n) & (100 * n >= 75 * q["n"])
                fits &= 7 * np.minimum(q["s"], p["s"][i]) >= 3 * (q["n"] + n)
                found += [sorted((int(p["node"][i]), int(q["node"][j]))) for j in np.flatnonzero(fits) if min(low & listed[j]) == v and _likely(own, qs[j])]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (a, b).

    Every node points to its smallest neighbour, the edges move to the nodes
    pointed to, and so on; each round at least halves the nodes that are left.
    """
    edges = scratch(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    found = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = scratch(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "pointers")
        # follow one more step: the pointers only ever lead down
        nxt = point.select(F.col("node").alias("to"), F.col("to").alias("then"))
        point = scratch(point.join(nxt, "to").select("node", F.col("then").alias("to")), "pointers")
        if found is None:
            found = point.withColumnRenamed("to", "root")
        else:
            step = point.select(F.col("node").alias("root"), "to")
            found = scratch(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = edges.join(point.select(F.col("node").alias("a"), F.col("to").alias("a_to")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("b_to")), "b")
        edges = scratch(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).where("a <> b").distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each id, in a map of fixed size."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    out = np.zeros(_BITS // 32, np.uint32)
    held = words.toArrow()  # at most _BITS / 32 rows
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _node_sets(ids: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, values) for the nodes in ``ids`` (doc_id)."""
    needed = _bitmap(ids)
    marked = texts.where("doc_id is not null").withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(_BITS)))
    sets = marked.mapInArrow(_sets(needed), "doc_id long, set_key binary, values array<long>")
    sets = sets.join(nodes.select(F.col("node").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    return scratch(sets.join(ids.distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "values"), "sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("values").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("values").alias("y"))
    return scratch(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"), "links")


def _common(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, s, weight): how many of a node's shingles other components hold too, and how common these are.

    Shingles are told apart by 32 bits here, which can only raise ``s``.
    """
    held = sets.select("node", F.explode("values").alias("token")).withColumn("token", F.expr("cast(token % 2147483648 as int)"))
    held = _rooted(held, small(roots))
    tokens = held.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi")
    tokens = scratch(tokens.select("token", "c"), "tokens")
    met = held.select("node", "token").join(tokens, "token")
    return scratch(met.groupBy("node").agg(F.count(F.lit(1)).alias("s"), F.sum(F.log("c")).alias("weight")), "common")


def _possible(entries: DataFrame) -> DataFrame:
    """Drop the entries whose node holds too few common shingles for any fitting partner in the list."""
    band = F.floor(F.log("n") / float(np.log(BAND))).cast("int")
    bit = F.expr("pmod(band, 62)")
    rows = entries.withColumn("band", band)
    lists = rows.groupBy("v").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))
    rows = rows.join(small(scratch(lists, "lists")), "v")  # a table of its own, so that the join may split a long list
    below = F.expr(f"array_max(filter(sequence(0, {BANDS_BELOW}), d -> (shiftright(mask, pmod(band - d, 62)) & 1L) = 1L))")
    least = F.greatest(F.col("n") * 0.75, F.pow(F.lit(BAND), F.col("band") - below))
    return rows.where(7 * F.col("s") >= 3 * (F.col("n") + least) - 1e-6).drop("band", "mask")


def _open_lists(entries: DataFrame) -> DataFrame:
    """Entries of lists that hold several components, with the list's length ``c``."""
    lists = entries.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi")
    return entries.join(small(scratch(lists.select("v", "c"), "lists")), "v")


def _typical(entries: DataFrame, classes: int) -> DataFrame:
    """(v, head, weight, head_root): the most typical node of each of a list's ``classes`` of nodes."""
    best = F.max(F.struct("weight", (-F.col("node")).alias("h"), "root")).alias("t")
    heads = entries.groupBy("v", F.pmod(F.xxhash64("node"), F.lit(classes)).alias("class")).agg(best)
    return scratch(heads.select("v", F.col("t.weight").alias("weight"), (-F.col("t.h")).alias("head"), F.col("t.root").alias("head_root")), "typical")


def _pairs(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of different components in a list, each once, that sizes, common shingles and sketches allow.

    The nodes outside the component of the list's most typical node ask all
    others. Askers and members are dealt over blocks, and each block of askers
    meets each block of members.
    """
    main = _typical(entries, 1).select("v", "head_root")
    rows = entries.select("v", "node", "root", "n", "s").join(main, "v").withColumn("asks", F.col("root") != F.col("head_root"))
    sizes = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.count_if("asks").alias("k")).where("k > 0")
    sketches = sets.select("node", F.slice("values", 1, K).alias("sketch"))
    rows = rows.join(scratch(sizes, "sizes"), "v").join(sketches, "node")
    rows = rows.withColumns({"ask_parts": F.ceil(F.col("k") / BLOCK).cast("int"), "parts": F.ceil(F.col("c") / BLOCK).cast("int"), "h": F.xxhash64("node")})
    entry = F.struct("node", "root", "n", "s", "asks", "sketch").alias("e")
    members = rows.select("v", F.explode(F.expr("sequence(0, ask_parts - 1)")).alias("i"), F.expr("cast(pmod(h, parts) as int)").alias("j"), entry)
    askers = rows.where("asks").select("v", F.expr("cast(pmod(h, ask_parts) as int)").alias("i"), F.explode(F.expr("sequence(0, parts - 1)")).alias("j"), entry)
    both = members.withColumn("as_asker", F.lit(False)).unionByName(askers.withColumn("as_asker", F.lit(True)))
    held = both.groupBy("v", "i", "j").agg(F.collect_list(F.when(F.col("as_asker"), F.col("e"))).alias("ask"), F.collect_list(F.when(~F.col("as_asker"), F.col("e"))).alias("m"))
    return held.select("v", "ask", "m").where("size(ask) > 0").mapInArrow(_alike, "a long, b long").distinct()


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    texts = _texts(docs)
    rows = scratch(texts.mapInArrow(_sketch, "doc_id long, n long, set_key binary, low array<long>"), "sketches")
    nodes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("low").alias("low"))
    nodes = scratch(nodes, "nodes")
    listed = nodes.where("node is not null").select("node", "set_key", "n", F.explode("low").alias("v"))

    heads = listed.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("head")).where("c > 1")
    entries = scratch(listed.join(heads, "v"), "entries")
    met = entries.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("times"))
    best = met.groupBy("node").agg(F.max(F.struct("times", (-F.col("head")).alias("h"))).alias("m")).where("m.times >= 2")
    pairs = scratch(best.select((-F.col("m.h")).alias("a"), F.col("node").alias("b")), "pairs")
    sets = _node_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), nodes, texts)
    links = _links(pairs, sets)
    discard(sets, pairs)
    roots = scratch(components(links), "roots")

    opened = scratch(_open_lists(_rooted(entries.drop("c", "head"), roots)).drop("c"), "open")
    discard(entries)
    often = opened.groupBy("node").agg(F.count(F.lit(1)).alias("_times")).where(F.col("_times") >= LEAST_LISTS).select("node")
    often = scratch(often, "often")
    sets = _node_sets(often.withColumnRenamed("node", "doc_id"), nodes, texts)
    common = _common(sets, roots)
    opened = scratch(_open_lists(_possible(opened.join(common, "node"))).drop("c"), "open")
    discard(common)

    met = opened.drop("weight").join(_typical(opened, HEADS), "v").where("root <> head_root").groupBy("node", "head").agg(F.count(F.lit(1)).alias("times"), F.first("weight").alias("weight"))
    named = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "weight", (-F.col("head")).alias("h"))), asc=False).alias("m"))  # HEADS * LISTED at most
    tried = named.select("node", F.explode(F.slice("m", 1, TRIED)).alias("m")).select((-F.col("m.h")).alias("a"), F.col("node").alias("b"))
    tried = scratch(tried, "pairs")
    links = links.unionByName(_links(tried, sets))
    discard(tried)
    roots = scratch(components(links), "roots")

    opened = scratch(_open_lists(_possible(_rooted(opened.drop("root"), roots))).drop("c"), "open")
    more = _links(scratch(_pairs(opened, sets), "likely"), sets)
    if not more.isEmpty():
        roots = scratch(components(links.unionByName(more)), "roots")

    classes = nodes.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = rows.select("doc_id", "n", "set_key").join(classes, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
