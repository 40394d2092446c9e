"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE splits a text into pre-tokens and merges bytes inside each.
Both are one deterministic transducer over characters. Its state holds the kind
of pre-token it is in, characters that wait for the next one (a blank, an
apostrophe), and how the bytes read so far may go on: after each prefix the
encoding has one last token, so all that can still matter are the token before
each place from which some token's beginning reaches the end, that beginning,
and how many tokens fewer it would be. There are finitely many such states. A
transition carries the number of tokens by which the count changes. States and
transitions are compiled from the vocabulary's merges when first taken, and kept.

A blank behind any other character leads to one and the same state whatever the
state before was. So a chunk of text acts on states simply: its head, up to the
first such place, is run from the state it is given; the rest has one count and
ends in one state. These maps compose associatively. Texts over ``long_chars``
are cut into rows of chunks, and their maps are composed level by level, FAN at
a time, so that no task holds more of a text than a chunk. (A text without any
blank is all head and is run in one piece.)

Defined results: null text counts as empty (no bytes, no tokens); repeated rows
each give a row; special strings inside a text are single tokens, as the
library has it by default; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States kept in a worker; beyond that the transducer is compiled anew.
_KEPT = 400_000
#: Chunk maps that are composed at once.
FAN = 64

START, LETTERS, NUMBERS, OTHERS, BLANKS, APOSTROPHE, ELIDED = range(7)
_LETTER, _NUMBER, _SPACE = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
# What an apostrophe at the start of a pre-token joins to.
SHORT, LONGER = "stmd", {"r": "e", "v": "e", "l": "l"}

#: (token before, node of the vocabulary's tree, tokens more than now) for each open beginning.
Hypotheses = tuple[tuple[int, int, int], ...]
State = tuple[int, str, Hypotheses]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The vocabulary: merges by rank, and a tree of all tokens."""

    def __init__(self, spec: dict):
        letters = {v: bytes([k]) for k, v in _byte_letters().items()}
        raw = lambda s: b"".join(letters[c] for c in s)
        pairs = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.tokens = [bytes([b]) for b in range(256)] + list(dict.fromkeys(a + b for a, b in pairs))
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = i
        self.stay: dict[tuple[int, int], bool] = {}

    def encode(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        rank_of, none = self.ranks.get, len(self.ranks)
        ranks = [rank_of(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), none)
        return parts

    def stays(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: the start): their bytes are encoded as these two."""
        key = a, b
        known = self.stay.get(key)
        if known is None:
            pair = [self.tokens[b]] if a < 0 else [self.tokens[a], self.tokens[b]]
            known = self.stay[key] = self.encode(b"".join(pair)) == pair
        return known

    def read(self, open_: Hypotheses, byte: int) -> tuple[int, Hypotheses]:
        """(change of the count, open beginnings) after one more byte of a pre-token."""
        moved, change, last = [], None, -1
        for before, node, more in open_:
            node = self.children[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            # the encoding is unique: the first that fits is it
            if change is None and token >= 0 and self.stays(before, token):
                change, last = more + 1, token
            if self.children[node]:
                moved.append((before, node, more))
        assert change is not None
        return change, (*((b, n, m - change) for b, n, m in moved), (last, 0, 0))


NEW: Hypotheses = ((-1, 0, 0),)


class Transducer:
    """States with their transitions: character -> (next state's transitions, change of the count)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec)
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.special_strings = special
        self.states: dict[State, dict] = {}

    def state(self, key: State) -> dict:
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= _KEPT:
                self.states = {}
            found = self.states[key] = {None: key}
        return found

    def run(self, row: dict, text: str) -> tuple[int, dict]:
        """(tokens, state) after a text without special strings."""
        n = 0
        for c in text:
            step = row.get(c)
            if step is None:
                count, key = self.step(row[None], c)
                step = row[c] = self.state(key), count
            row, d = step
            n += d
        return n, row

    def feed(self, open_: Hypotheses, text: str) -> tuple[int, Hypotheses]:
        n = 0
        for b in text.encode("utf-8", "surrogatepass"):
            d, open_ = self.merges.read(open_, b)
            n += d
        return n, open_

    def begin(self, c: str, lead: str = "") -> tuple[int, State]:
        """A new pre-token whose first character is c, behind a blank or none."""
        if _SPACE.match(c):
            return 0, (BLANKS, c, NEW)
        if c == "'" and not lead:
            return 0, (APOSTROPHE, c, NEW)
        n, open_ = self.feed(NEW, lead + c)
        return n, (LETTERS if _LETTER.match(c) else NUMBERS if _NUMBER.match(c) else OTHERS, "", open_)

    def step(self, state: State, c: str) -> tuple[int, State]:
        kind, waits, open_ = state
        if kind in (LETTERS, NUMBERS, OTHERS):
            goes_on = bool(_LETTER.match(c)) if kind == LETTERS else bool(_NUMBER.match(c)) if kind == NUMBERS else not (_LETTER.match(c) or _NUMBER.match(c) or _SPACE.match(c))
            if not goes_on:
                return self.begin(c)
            n, open_ = self.feed(open_, c)
            return n, (kind, "", open_)
        if kind == BLANKS:
            if _SPACE.match(c):
                n, open_ = self.feed(open_, waits)
                return n, (BLANKS, c, open_)
            if waits == " ":
                return self.begin(c, " ")
            alone = self.feed(NEW, waits)[0]
            n, state = self.begin(c)
            return alone + n, state
        if kind == APOSTROPHE:
            if c in SHORT:
                return self.feed(NEW, "'" + c)[0], (START, "", NEW)
            if c in LONGER:
                return 0, (ELIDED, c, NEW)
            n, open_ = self.feed(NEW, "'")
            more, state = self.step((OTHERS, "", open_), c)
            return n + more, state
        if kind == ELIDED:
            if c == LONGER[waits]:
                return self.feed(NEW, "'" + waits + c)[0], (START, "", NEW)
            n, open_ = self.feed(NEW, waits)
            more, state = self.step((LETTERS, "", open_), c)
            return self.feed(NEW, "'")[0] + n + more, state
        return self.begin(c)

    def end(self, row: dict) -> int:
        """What the end of a text adds."""
        kind, waits, open_ = row[None]
        if kind == BLANKS:
            return self.feed(open_, waits)[0]
        if kind in (APOSTROPHE, ELIDED):
            return self.feed(NEW, "'")[0] + (self.feed(NEW, waits)[0] if kind == ELIDED else 0)
        return 0

    def read(self, row: dict, text: str) -> tuple[int, dict]:
        """Like ``run``, with special strings."""
        if not any(s in text for s in self.special_strings):
            return self.run(row, text)
        pieces, total = self.special.split(text), 0
        for i, piece in enumerate(pieces):
            n, row = self.run(row, piece)
            total += n
            if i + 1 < len(pieces):
                total += self.end(row) + 1
                row = self.start()
        return total, row

    def start(self) -> dict:
        return self.state((START, "", NEW))

    def count(self, text: str) -> int:
        n, row = self.read(self.start(), text)
        return n + self.end(row)


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


# --- chunk maps -----------------------------------------------------------

#: (head, whether a blank behind another character ends it, count behind it, state at the end as JSON).
ChunkMap = tuple[str, bool, int, str]
_SETTLED = regex.compile(r"\S\s")


def chunk_map(t: Transducer, chunk: str) -> ChunkMap:
    found = _SETTLED.search(chunk)
    if not found or any(s in chunk[: found.end()] for s in t.special_strings):
        return chunk, False, 0, ""
    head, blank = chunk[: found.end()], chunk[found.end() - 1]
    n, row = t.read(t.state((BLANKS, blank, NEW)), chunk[found.end() :])
    return head, True, n, json.dumps(row[None])


def _row(t: Transducer, written: str) -> dict:
    kind, waits, open_ = json.loads(written)
    return t.state((kind, waits, tuple(map(tuple, open_))))


def compose(t: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """The map of consecutive chunks."""
    heads, n, row = [], 0, None
    for head, settled, count, after in maps:
        if row is None:
            heads.append(head)
        else:
            more, row = t.read(row, head)
            n += more
        if settled:
            n, row = n + count, _row(t, after)
    return "".join(heads), row is not None, n, json.dumps(row[None]) if row else ""


def applied(t: Transducer, m: ChunkMap) -> int:
    """Tokens of a text, from its map."""
    head, settled, count, after = m
    n, row = t.read(t.start(), head)
    if settled:
        n, row = n + count, _row(t, after)
    return n + t.end(row)


def cuts(t: Transducer, text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters; none ends within a special string."""
    a, reach = 0, max(map(len, t.special_strings), default=1)
    while a < len(text):
        b = a + size
        for m in t.special.finditer(text, max(a, b - reach), min(len(text), b + reach)):
            if m.start() < b < m.end():
                b = m.end()
        yield text[a:b]
        a = b


def _cutter(path: str, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            for key, text in zip(b.column("key"), b.column("text"), strict=True):
                for i, piece in enumerate(cuts(t, text.as_py(), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([i], pa.int64()), pa.array([piece])], ["key", "i", "chunk"])

    return run


_MAP = "key string, i long, head string, settled boolean, n long, after string"


def _mapper(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            made = [chunk_map(t, c.as_py()) for c in b.column("chunk")]
            columns = zip(*made, strict=True) if made else [[]] * 4
            types = (pa.string(), pa.bool_(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("i"), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], ["key", "i", "head", "settled", "n", "after"])

    return run


def _composer(path: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        maps = [(r["head"], r["settled"], r["n"], r["after"]) for r in rows.to_pylist()]
        head, settled, n, after = compose(transducer(path), maps)
        return pa.table({"key": rows.column("key")[:1], "i": pa.array([rows.column("i")[0].as_py() // FAN]), "head": [head], "settled": [settled], "n": pa.array([n], pa.int64()), "after": [after]})

    return run


def _finisher(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n = [applied(t, (r["head"], r["settled"], r["n"], r["after"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    return run


def _counter(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            n = [t.count(x.as_py() or "") for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def long_counts(texts: DataFrame, path: str, *, chunk_chars: int, longest: int) -> DataFrame:
    """(key, n_tokens) of distinct (key, text): chunks in rows of their own, maps composed FAN at a time."""
    chunks = texts.mapInArrow(_cutter(path, chunk_chars), "key string, i long, chunk string")
    maps = chunks.repartition("key", "i").mapInArrow(_mapper(path), _MAP)
    left = -(-longest // chunk_chars)
    while left > 1:
        maps = maps.groupBy("key", F.expr(f"i div {FAN}").alias("g")).applyInArrow(_composer(path), _MAP)
        left = -(-left // FAN)
    return maps.mapInArrow(_finisher(path), "key string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, chunk_chars: int = 65_536, long_chars: int = 1_048_576) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. The tokenizer's file is read where the tasks run."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    is_long = F.coalesce(F.char_length("text") > long_chars, F.lit(False))
    out = rows.where(~is_long).mapInArrow(_counter(tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    longest = rows.agg(F.max(F.char_length("text"))).first()[0] or 0
    if longest > long_chars:
        large = rows.where(is_long).withColumn("key", F.sha2("text", 256))
        counts = long_counts(large.select("key", "text").dropDuplicates(["key"]), tokenizer_path, chunk_chars=chunk_chars, longest=longest)
        out = out.unionByName(large.select("doc_id", "n_bytes", "key").join(counts, "key").drop("key"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
