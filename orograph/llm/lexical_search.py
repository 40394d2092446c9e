"""Ranked lexical search over a clustered index whose shards follow a recursive graph bisection.

*Order.* Documents and terms form a graph. Recursive bisection halves the
documents of a bounded sample so that documents with the same terms end on the
same side: documents move while that lowers the estimated bits of the gaps in
both sides' lists, then each half is halved. The tree that results (the gain
of each term at each node, and the median) sends every document of the corpus
to a leaf by its own terms. The order of leaves is the new order of documents.

*Index.* In that order documents are cut into shards, one row each: the
shard's terms, each with its highest impact, and the impacts of its documents
by place in the shard. ``doc_ids`` leads from places back to documents. Every
document is in the index whatever the sample held; a leaf with a third of all
documents is many shards.

*Search.* A query's bound in a shard is the sum of the shard's highest
impacts. Shards are visited in rounds by falling bound; a query ends when no
unvisited shard's bound reaches its k-th best score (equal scores can still
win by a smaller doc_id), so results are exact. What a task knows of queries is
a block of bounded size; scores stay in the tasks, k rows for each query and
shard leave them.

Defined results: null texts and texts without terms count as no document;
repeated rows are ranked one by one; a null doc_id comes after all others among
equal scores; repeated or null item_ids are queries of their own. Other columns
are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orograph.llm.common import each_text, rows_at_once, scratch, utf8

#: Documents of the sample that the bisection is fitted on, and the most bytes of one of them.
SAMPLE, SAMPLE_BYTES = 4096, 1 << 16
#: Halvings, and rounds of moves in each.
DEPTH, MOVES = 6, 12
#: A shard ends at so many documents or entries.
SHARD_DOCS, SHARD_ENTRIES = 1024, 1 << 17
#: Queries and bytes of their texts that are searched at once; what tasks are sent grows with these alone.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 4 << 20
#: Shard numbers that are sent to all tasks at most.
MOST_SENT = 100_000

_SEPARATORS = bytes(i for i in range(128) if not chr(i).isalnum())
_FOLD = bytes(32 if i in _SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_FORWARD = "doc_id long, leaf int, n long, terms binary, counts array<int>"
_INDEX = "shard long, doc_ids array<long>, terms array<binary>, dfs array<int>, bounds array<long>, places array<short>, impacts array<int>"
_HITS = "query int, doc_id long, score long"


def terms_of(text: bytes) -> list[bytes]:
    """Stretches of ASCII letters, digits and all other characters beyond ASCII; A-Z in lower case."""
    return text.translate(_FOLD).split()


# --- the order --------------------------------------------------------------


@dataclass
class Tree:
    """Numbers of the terms that the sample held; for each term its gain for the left side at each node (1 is the root), and the nodes' cuts."""

    terms: dict[bytes, int]
    gains: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaf(self, terms: Iterable[bytes]) -> int:
        """Where a document with these (distinct) terms belongs."""
        known = np.array([i for i in map(self.terms.get, terms) if i is not None], np.int64)
        right, node = self.gains[known].sum(0) < self.cuts, 1
        for _ in range(self.depth):
            node = 2 * node + int(right[node])
        return node - (1 << self.depth)


def _gains(term: np.ndarray, side: np.ndarray, terms: int, sizes: tuple[int, int]) -> np.ndarray:
    """For each term, the bits that a document's entry costs on the right less those on the left, from the degrees on both sides."""
    left = np.bincount(term[side], minlength=terms)
    right = np.bincount(term[~side], minlength=terms)
    cost = [n * np.log2((size + 1) / (n + 1)) for n, size in ((left, sizes[0]), (left + 1, sizes[0]), (right, sizes[1]), (right + 1, sizes[1]))]
    return ((cost[3] - cost[2]) - (cost[1] - cost[0])).astype(np.float32)


def fit_tree(documents: list[list[bytes]], *, depth: int = DEPTH, moves: int = MOVES) -> Tree:
    """Bisect a sample of documents, given by their distinct terms, ``depth`` times."""
    shared = Counter(t for d in documents for t in d)
    terms = {t: i for i, t in enumerate(sorted(t for t, n in shared.items() if n > 1))}
    lists = [np.array([terms[t] for t in d if t in terms], np.int64) for d in documents]
    gains, cuts = np.zeros((len(terms), 1 << depth), np.float32), np.zeros(1 << depth, np.float32)
    nodes = {1: np.arange(len(lists))}
    for node in range(1, 1 << depth):
        members = nodes.pop(node, np.zeros(0, np.int64))
        term = np.concatenate([lists[i] for i in members]) if len(members) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(members)), [len(lists[i]) for i in members])
        side, half = np.arange(len(members)) % 2 == 0, (len(members) + 1) // 2
        value = np.zeros(len(members))
        for _ in range(moves):
            gain = _gains(term, side[owner], len(terms), (half, len(members) - half))
            value = np.bincount(owner, gain[term], len(members))
            gains[:, node] = gain
            # those that lose most by being on the left change places with those that gain most, while a pair of them gains
            left, right = np.flatnonzero(side), np.flatnonzero(~side)
            left, right = left[np.argsort(value[left], kind="stable")], right[np.argsort(-value[right], kind="stable")]
            pairs = min(len(left), len(right))
            swap = np.flatnonzero(value[right[:pairs]] - value[left[:pairs]] > 0)
            if not len(swap):
                break
            side[left[swap]], side[right[swap]] = False, True
        value = np.array([gains[lists[i], node].sum() for i in members], np.float32)
        cuts[node] = np.median(value) if len(value) else 0
        nodes[2 * node], nodes[2 * node + 1] = members[value >= cuts[node]], members[value < cuts[node]]
    return Tree(terms, gains, cuts, depth)


def fit_order(docs: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, depth: int = DEPTH) -> Tree:
    """A tree from ``sample`` documents at most: those whose doc_id's hash is small, of at most ``sample_bytes`` bytes each."""
    text, total = utf8(F.col("text")), docs.count()
    rows = docs.select(F.xxhash64("doc_id").alias("at"), text.alias("text")).where((F.octet_length("text") <= sample_bytes) & (F.octet_length("text") > 0))
    share = min(1.0, 1.1 * sample / max(1, total))
    chosen = rows.where(F.col("at") <= int((share - 0.5) * 2.0**64)) if share < 0.5 else rows
    return fit_tree([sorted(set(terms_of(bytes(r.text)))) for r in chosen.select("text").limit(sample).collect()], depth=depth)


# --- the index --------------------------------------------------------------


def _forward(tree: Tree):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["doc_id", "leaf", "n", "terms", "counts"], (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()))

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            rows = []
            for d, text in zip(b.column("doc_id"), each_text(b), strict=True):
                words = terms_of(text)
                if words:
                    found = Counter(words)
                    rows.append((d.as_py(), tree.leaf(found), len(words), b" ".join(found), np.fromiter(found.values(), np.int32, len(found))))
                if len(rows) == 500:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return run


def _shard(number: int, doc_ids: list, terms: list[bytes], counts: np.ndarray, per_doc: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """One row of the index."""
    known: defaultdict[bytes, int] = defaultdict(int)
    known.default_factory = known.__len__
    term = np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))
    place = np.arange(len(doc_ids)).repeat(per_doc)
    impact = 1_000_000_000 * counts // (1000 * counts + 20 * m[place])
    order = np.argsort(term, kind="stable")
    df = np.bincount(term, minlength=len(known))
    begins = np.cumsum(df) - df
    impact, place = impact[order], place[order]

    def one(values, kind):
        return pa.array([values], pa.list_(kind))

    columns = [
        pa.array([number], pa.int64()),
        one(doc_ids, pa.int64()),
        one(list(known), pa.binary()),
        one(df, pa.int32()),
        one(np.maximum.reduceat(impact, begins), pa.int64()),
        one(place, pa.int16()),
        one(impact, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["shard", "doc_ids", "terms", "dfs", "bounds", "places", "impacts"])


def _build(documents: int, length: int, most_docs: int, most_entries: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, terms, counts, sizes, words, leaf = [], [], [], [], [], None

        def flush():
            nonlocal made, ids, terms, counts, sizes, words
            n = np.array(words, np.int64)
            out = _shard(part << 32 | made, ids, terms, np.concatenate(counts), np.array(sizes), 50 + (50 * n * documents) // length)
            made += 1
            ids, terms, counts, sizes, words = [], [], [], [], []
            return out

        for b in batches:
            columns = [b.column(c) for c in ("doc_id", "leaf", "n", "terms", "counts")]
            for d, at, n, blob, count in zip(*columns, strict=True):
                count = count.values.to_numpy()
                full = len(ids) >= most_docs or len(terms) + len(count) > most_entries
                if ids and (full or (at.as_py() != leaf and len(ids) >= most_docs // 4)):
                    yield flush()
                leaf = at.as_py()
                ids.append(d.as_py())
                terms.extend(blob.as_py().split(b" "))
                counts.append(count.astype(np.int64))
                sizes.append(len(count))
                words.append(n.as_py())
        if ids:
            yield flush()

    return run


@dataclass
class Index:
    """``shards`` has a row for each shard; ``documents`` have terms, ``length`` of them with repeats."""

    shards: DataFrame
    documents: int
    length: int


def build_index(docs: DataFrame, *, tree: Tree | None = None, shard_docs: int = SHARD_DOCS, shard_entries: int = SHARD_ENTRIES) -> Index:
    """Index every document with terms; the tables are scratch tables."""
    spark = docs.sparkSession
    tree = tree or fit_order(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    forward = scratch(texts.mapInArrow(_forward(tree), _FORWARD), "forward")
    total = forward.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    # the leaf's order, spread by a row number so that a leaf with very many documents is cut too
    order = forward.withColumn("_at", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order.repartitionByRange(parts, "leaf", "_at").sortWithinPartitions("leaf", "_at").drop("_at")
    shards = order.mapInArrow(_build(total.documents, max(1, total.length), shard_docs, shard_entries), _INDEX)
    return Index(scratch(shards, "shards"), total.documents, total.length)


# --- search -----------------------------------------------------------------


@dataclass
class Block:
    """Queries of one block: query q has the terms ``term[begins[q]:begins[q + 1]]`` (numbers from ``terms``), each with a weight."""

    terms: dict[bytes, int]
    term: np.ndarray
    weight: np.ndarray
    begins: np.ndarray
    k: int

    def bounds(self, shard_bounds: np.ndarray) -> np.ndarray:
        """The highest score that each query could reach, from the highest impact of each of the block's terms."""
        sums = np.concatenate([[0], np.cumsum(self.weight * shard_bounds[self.term])])
        return sums[self.begins[1:]] - sums[self.begins[:-1]]


def _local(block: Block, row_terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the shard's terms occur in the block, and their numbers there."""
    numbers = list(map(block.terms.get, row_terms.to_pylist()))
    at = np.array([i for i, t in enumerate(numbers) if t is not None], np.int64)
    return at, np.array([numbers[i] for i in at], np.int64)


def _bounds(block: Block):
    """(query, shard, bound) where the bound is above 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, terms, bounds in zip(b.column("shard"), b.column("terms"), b.column("bounds"), strict=True):
                at, number = _local(block, terms.values)
                best = np.zeros(len(block.terms), np.int64)
                best[number] = bounds.values.to_numpy()[at]
                bound = block.bounds(best)
                query = np.flatnonzero(bound > 0)
                columns = [pa.array(query, pa.int32()), pa.array(np.full(len(query), shard.as_py()), pa.int64()), pa.array(bound[query], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "shard", "bound"])

    return run


def _visit(block: Block, low: np.ndarray, high: np.ndarray, least: np.ndarray):
    """The best documents of each query in each shard whose bound is in [low, high), if they score ``least`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in zip(*(b.column(c) for c in ("doc_ids", "terms", "dfs", "bounds", "places", "impacts")), strict=True):
                doc_ids, terms, dfs, bounds, places, impacts = (c.values for c in shard)
                at, number = _local(block, terms)
                best = np.zeros(len(block.terms), np.int64)
                best[number] = bounds.to_numpy()[at]
                bound = block.bounds(best)
                todo = np.flatnonzero((bound > 0) & (bound >= low) & (bound < high))
                if not len(todo):
                    continue
                df = dfs.to_numpy().astype(np.int64)
                first, count = np.zeros(len(block.terms), np.int64), np.zeros(len(block.terms), np.int64)
                first[number], count[number] = (np.cumsum(df) - df)[at], df[at]
                places_, impacts_ = places.to_numpy(), impacts.to_numpy().astype(np.int64)
                known = doc_ids.is_null().to_numpy(zero_copy_only=False)
                ids = doc_ids.fill_null(0).to_numpy()
                out = []
                for q in todo:
                    mine = slice(block.begins[q], block.begins[q + 1])
                    score = np.zeros(len(ids), np.int64)
                    for t, w in zip(block.term[mine].tolist(), block.weight[mine].tolist(), strict=True):
                        entries = slice(first[t], first[t] + count[t])
                        score[places_[entries]] += w * impacts_[entries]
                    hit = np.flatnonzero((score > 0) & (score >= least[q]))
                    hit = hit[np.lexsort((ids[hit], known[hit], -score[hit]))[: block.k]]
                    out.append((np.full(len(hit), q), hit, score[hit]))
                query, hit, score = (np.concatenate(c) for c in zip(*out, strict=True))
                columns = [pa.array(query, pa.int32()), pa.array(ids[hit], pa.int64(), mask=known[hit]), pa.array(score, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(index: Index, items: list[list[bytes]], k: int, first: int) -> DataFrame:
    """(query, rank, doc_id, score) for items given by their distinct terms."""
    spark = index.shards.sparkSession
    numbers: dict[bytes, int] = {t: i for i, t in enumerate(sorted({t for i in items for t in i}))}
    wanted = F.broadcast(spark.createDataFrame([(bytearray(t), i) for t, i in numbers.items()], "term binary, number int"))
    pairs = index.shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), F.col("e.dfs").alias("df"))
    df = pairs.join(wanted, "term").groupBy("number").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = np.zeros(len(numbers), np.int64)
    for r in df.select("number", weight).collect():
        weights[r.number] = r.w
    term = np.array([numbers[t] for i in items for t in i], np.int64)
    begins = np.concatenate([[0], np.cumsum([len(i) for i in items])])
    block = Block(numbers, term, weights[term], begins, k)

    bounds = scratch(index.shards.select("shard", "terms", "bounds").mapInArrow(_bounds(block), "query int, shard long, bound long"), "bounds")
    low, high = np.zeros(len(items), np.int64), np.full(len(items), np.iinfo(np.int64).max)
    least, found, visits = np.ones(len(items), np.int64), None, first
    while True:
        # the bound of the shard that comes ``visits`` places further on, for each query
        open_ = bounds.join(F.broadcast(spark.createDataFrame([(q, int(high[q]), int(least[q])) for q in range(len(items))], "query int, high long, least long")), "query")
        open_ = open_.where((F.col("bound") < F.col("high")) & (F.col("bound") >= F.col("least")))
        ranked = open_.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound")))).where(F.col("r") <= visits)
        low[:] = np.iinfo(np.int64).max
        for r in ranked.groupBy("query").agg(F.min("bound").alias("low")).collect():
            low[r["query"]] = r.low
        if (low == np.iinfo(np.int64).max).all():
            return found if found is not None else spark.createDataFrame([], "query int, doc_id long, score long, rank int")
        reach = spark.createDataFrame([(q, int(low[q]), int(high[q])) for q in range(len(items))], "query int, low long, high long")
        rows = index.shards
        visited = bounds.join(F.broadcast(reach), "query").where((F.col("bound") >= F.col("low")) & (F.col("bound") < F.col("high")))
        visited = scratch(visited.select("shard").distinct(), "visited")
        if visited.limit(MOST_SENT + 1).count() <= MOST_SENT:  # otherwise tasks look at all shards' bounds
            rows = rows.join(F.broadcast(visited), "shard", "left_semi")
        hits = rows.select("doc_ids", "terms", "dfs", "bounds", "places", "impacts").mapInArrow(_visit(block, low, high, least), _HITS)
        found = scratch(_top(hits if found is None else found.select("query", "doc_id", "score").unionByName(hits), k), "found")
        for r in found.where(F.col("rank") == k).select("query", "score").collect():
            least[r["query"]] = r.score
        high, visits = np.minimum(high, low), visits * 8


def search(index: Index, items: DataFrame, *, k: int = 50, first: int = 4, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item; ``first`` shards are visited at first."""
    spark = items.sparkSession
    out: DataFrame | None = None

    def done(rows: list) -> None:
        nonlocal out
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "query int, item_id long")
        with rows_at_once(spark, 1):  # of the index: a shard
            ranked = _search_block(index, [r[1] for r in rows], k, first)
        ranked = ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)

    block, held = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), utf8(F.col("text")).alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(bytes(r.text))))
        if not terms or not index.documents:
            continue
        if block and (len(block) >= block_items or held + len(r.text) > block_bytes):
            done(block)
            block, held = [], 0
        block.append((r.item_id, terms))
        held += len(r.text)
    if block:
        done(block)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def oracle(k: int = 50) -> str:
    """The same in SQL, by scoring every pair of an item and a document that share a term."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {words} AS ws FROM documents WHERE text IS NOT NULL),
        full_ AS (SELECT * FROM d WHERE len(ws) > 0),
        total AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS words FROM full_),
        tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(ws) AS n, unnest(ws) AS term FROM full_) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest({words}) AS term FROM benchmark)),
        s AS (SELECT item, item_id, doc, doc_id,
                     sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                         * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), total GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
