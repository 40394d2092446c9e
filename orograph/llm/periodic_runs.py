"""Runs of words that repeat with a period, by Crochemore's partition refinement.

Positions with equal factors of one length form classes. From one length to
the next, only positions before members of *small* classes are dealt anew: of
the parts that a class falls into, the largest is left out, so a position takes
part a logarithmic number of times. Each position knows the next member of its
class; where that lies exactly one factor length ahead, a square begins, and
its root is primitive. Squares of one period that begin at consecutive words
are one run.

Many texts are refined at once: each ends with a mark of its own, and classes
never hold positions of two texts.

Defined results: words are stretches without ASCII white space; a null or empty
text has no words, no runs and an empty collapsed text; every row is handled by
itself, whatever its doc_id (null and repeated ones too). Other columns are
ignored. A text is handled whole in one task; memory is about 200 bytes a word
of the longest text, and a million words at least.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import each_text, utf8

#: Words that are refined at once, if no single text has more.
BATCH_WORDS = 1 << 20
_BITS = 21
_LOW = (1 << _BITS) - 1
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _sorted_by(major: np.ndarray, minor: np.ndarray, place: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three columns in the order of all three; values are under ``below``."""
    if below <= _LOW + 1:
        packed = major << (2 * _BITS) | minor << _BITS | place
        packed.sort()
        return packed >> (2 * _BITS), packed >> _BITS & _LOW, packed & _LOW
    order = np.lexsort((place, minor, major))
    return major[order], minor[order], place[order]


def _sorted_places(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places in the order of (group, place)."""
    if len(place) < 2:
        return place
    if int(group.max()) < 1 << 31 and int(place.max()) < 1 << 31:
        packed = group << 32 | place
        packed.sort()
        return packed & 0xFFFFFFFF
    return place[np.lexsort((place, group))]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for k in keys[1:]:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counts(starts: np.ndarray, total: int) -> np.ndarray:
    """How many rows each start stands for."""
    count = np.empty(len(starts), np.int64)
    count[:-1] = starts[1:] - starts[:-1]
    count[-1] = total - starts[-1]
    return count


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each pair, one after the other."""
    if len(count) == 1:
        return np.arange(first[0], first[0] + count[0])
    ends = count.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + (first - ends + count).repeat(count)


def _first_of(index: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of the chosen rows ``index`` the first in each group; groups are sorted."""
    return index[_starts(group[index])] if len(index) else index


def primitive_squares(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square with a primitive root in texts given as word numbers, one after the other.

    Starts count the end mark of each earlier text as one word.
    """
    total, texts = len(ids) + len(lengths), len(lengths)
    text = np.repeat(np.arange(texts), lengths + 1)
    word = np.zeros(total, np.int64)
    inside = np.ones(total, bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    word[inside] = ids + 1
    longest = np.repeat(lengths // 2, lengths + 1)  # no square of the text has a longer period
    below = max(total, int(word.max(initial=0)) + 1)

    # length 1: the classes are the words of each text
    text_of, word_of, elements = _sorted_by(text, word, np.arange(total), below)
    at = _starts(text_of, word_of)
    start, size = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
    classes = len(at)
    start[:classes], size[:classes] = at, _counts(at, total)
    cls, where = np.empty(total, np.int64), np.empty(total, np.int64)
    cls[elements], where[elements] = np.arange(classes).repeat(size[:classes]), np.arange(total)
    after, before = np.full(total + 1, total), np.full(total + 1, total)  # the place ``total`` stands for none
    same = np.flatnonzero(cls[elements[1:]] == cls[elements[:-1]])
    after[elements[same]], before[elements[same + 1]] = elements[same + 1], elements[same]
    since = np.ones(total, np.int64)
    owner = text_of[at]
    largest = np.maximum.reduceat(size[:classes], _starts(owner))[owner]
    small = np.ones(classes, bool)
    small[_first_of(np.flatnonzero(size[:classes] == largest), owner)] = False
    small = np.flatnonzero(small)
    moving = np.zeros(total + 1, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def report(p: np.ndarray, upto: np.ndarray | int) -> None:
        a = after[p]
        gap = a - p
        square = np.flatnonzero((since[p] <= gap) & (gap <= upto) & (a < total))
        if len(square):
            found.append((p[square], gap[square]))

    for length in range(2, int(longest.max(initial=0)) + 1):
        nexts = elements[_ranges(start[small], size[small])]
        t = nexts[nexts > 0] - 1
        t = t[(size[cls[t]] > 1) & (longest[t] >= length)]
        if not len(t):
            break
        old, by, t = _sorted_by(cls[t], cls[t + 1], t, below)
        groups = _starts(old, by)
        count = _counts(groups, len(t))
        from_ = old[groups]
        heads = _starts(from_)
        split = from_[heads]
        which = np.arange(len(heads)).repeat(_counts(heads, len(groups)))
        taken, most = np.add.reduceat(count, heads), np.maximum.reduceat(count, heads)
        left = size[split] - taken
        if not left.all():
            # a class whose members all have to move keeps its largest part in place
            stay = _first_of(np.flatnonzero((left[which] == 0) & (count == most[which])), which)
            go = np.ones(len(groups), bool)
            go[stay] = False
            t, count, which = t[go.repeat(count)], count[go], which[go]
            if not len(t):
                break
            heads = _starts(which)
            split = split[which[heads]]
            which = np.arange(len(heads)).repeat(_counts(heads, len(which)))
            taken, most = np.add.reduceat(count, heads), np.maximum.reduceat(count, heads)
            left = size[split] - taken

        # what stays: neighbours on both sides of each stretch that goes meet
        moving[t] = True
        group = split.repeat(taken)
        opens = ~moving[before[t]]
        closes = ~moving[after[t]]
        b, a = before[_sorted_places(group[opens], t[opens])], after[_sorted_places(group[closes], t[closes])]
        before[a] = b
        kept = b < total
        b, a = b[kept], a[kept]
        report(b, length - 1)
        after[b], since[b] = a, length

        # what goes: neighbours in the new classes
        bounds = count.cumsum()
        following, preceding = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        following[:-1], preceding[1:] = t[1:], t[:-1]
        following[bounds - 1], preceding[bounds - count] = total, total
        changed = t[following != after[t]]
        report(changed, length - 1)
        since[changed] = length
        after[t], before[t] = following, preceding

        # what goes moves to the end of its class's stretch of elements, new classes one after the other
        end = start[split] + left
        slots = _ranges(end, taken)
        inner = where[t]
        holes = inner[inner < end.repeat(taken)]
        strays = elements[slots]
        strays = strays[~moving[strays]]
        elements[holes], where[strays] = strays, holes
        elements[slots], where[t] = t, slots
        moving[t] = False
        new = classes + np.arange(len(count))
        classes += len(count)
        start[new], size[new], cls[t] = slots[bounds - count], count, new.repeat(count)
        size[split] = left

        # the largest part of each class is not looked at again
        turned = most > left
        if turned.any():
            look = np.ones(len(count), bool)
            look[_first_of(np.flatnonzero((count == most[which]) & turned[which]), which)] = False
            small = np.concatenate([new[look], split[turned]])
        else:
            small = new
    report(np.arange(total), longest)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def find_runs(ids: np.ndarray, lengths: np.ndarray, *, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of at least ``shortest`` words and two periods, by text, start and period."""
    begin, period = primitive_squares(ids, lengths)
    order = np.lexsort((begin, period))
    begin, period = begin[order], period[order]
    if not len(begin):
        return begin, begin, begin, period
    opens = np.ones(len(begin), bool)
    opens[1:] = (begin[1:] != begin[:-1] + 1) | (period[1:] != period[:-1])
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(begin)) - 1
    start, period, length = begin[first], period[first], begin[last] - begin[first] + 2 * period[first]
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.searchsorted(offsets, start, "right") - 1
    order = np.lexsort((period, start))
    order = order[length[order] >= shortest]
    return text[order], (start - offsets[text])[order], length[order], period[order]


def _refined(rows: list[tuple[object, list[bytes]]], numbers: list[np.ndarray], shortest: int) -> pa.RecordBatch:
    lengths = np.array([len(w) for _, w in rows], np.int64)
    text, start, length, period = find_runs(np.concatenate(numbers), lengths, shortest=shortest)
    bounds = np.searchsorted(text, np.arange(len(rows) + 1))
    collapsed = []
    for k, (_, words) in enumerate(rows):
        lo, hi = bounds[k], bounds[k + 1]
        if lo < hi:
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start[lo:hi] + period[lo:hi], 1)
            np.add.at(change, start[lo:hi] + length[lo:hi], -1)
            keep = (np.cumsum(change)[:-1] == 0).tolist()
            words = [w for w, k_ in zip(words, keep, strict=True) if k_]
        collapsed.append(b" ".join(words))
    runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(_RUN))
    columns = [
        pa.array([d for d, _ in rows], pa.int64()),
        pa.array(lengths, pa.int64()),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
        pa.array(collapsed, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])


def _numbering() -> defaultdict[bytes, int]:
    """Gives each new word the next number."""
    known = defaultdict(int)
    known.default_factory = known.__len__
    return known


def _search(shortest: int, batch_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, numbers, words_held, known = [], [], 0, _numbering()
        for b in batches:
            for d, text in zip(b.column("doc_id"), each_text(b), strict=True):
                words = text.split()  # of bytes: at ASCII white space only
                if rows and words_held + len(words) + 1 > batch_words:
                    yield _refined(rows, numbers, shortest)
                    rows, numbers, words_held, known = [], [], 0, _numbering()
                rows.append((d.as_py(), words))
                numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                words_held += len(words) + 1
        if rows:
            yield _refined(rows, numbers, shortest)

    return run


def periodic_runs(docs: DataFrame, *, shortest: int = 12, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period by start, then period) and the collapsed text.

    A run is a stretch of words with smallest period ``period`` and a length of
    at least two periods and ``shortest`` words that neither neighbouring word
    extends. The collapsed text keeps, of each run, the first period, and joins
    words by one space.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return texts.mapInArrow(_search(shortest, batch_words), SCHEMA)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words from some place on repeat with a period in a tenth of the documents, chosen by doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.when(h % 10 == 0, h))  # null where nothing is changed
    words = F.expr(r"filter(split(if(h is null, '', coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), w -> w != '')")
    docs = docs.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat_ws(' ', transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])))")
    return docs.select("doc_id", F.when(F.col("h").isNull(), F.col("text")).otherwise(again).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The result of ``periodic_runs`` as counts, the longest run and digests."""
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'before', -r.start, 'shorter', -r.period)))")
    lines = F.expr(r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("(1000 * best.length) div (-best.shorter)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
