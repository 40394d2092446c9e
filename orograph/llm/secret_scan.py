"""Secrets in text: fixed patterns, and a linear-chain CRF that tags what they miss.

The CRF tags white-space tokens as begin, inside or outside of a secret from
their shape (length, character classes, how often these change), the words
around them and features of the whole text; Viterbi finds the best tags.

It learns from a bounded sample of rows, drawn from those with a pattern's match
and from those without. Around a match the window is given as it is and, so that
the model learns more than the patterns know, in variants: with the words before
the value taken out, with the value replaced by a made one of another form
(prefixed keys, mixed letters and digits, base64, values cut over several
tokens), or put after a word and no sign. Each text of the sample shows a made
value somewhere, so that rare matches are enough to learn from. Odd tokens that
are no secrets (numbers, addresses, dates, names) and made ones like them are
shown as outside. The made strings come from a generator seeded by the row's hash.

Where "outside" leads by more than any change of two transitions could make up,
the best path is outside there whatever stands around; Viterbi runs on the
stretches between such tokens. This is exact, and keeps most text out of it.

Defined results: null text counts as empty (no spans); repeated rows each give
a row, and count once in the sample; a CRF span that overlaps a pattern's span is
dropped for it; without any text to learn from every token is outside.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import each_text, scratch, utf8

# The patterns and the least lengths of their matches (assign: of group 2).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the patterns' matches, in code points."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return ordered(found)


def values_of(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands in each of the patterns' matches, in order and none over another."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(a, b) for a, b, kind in base_spans(text) if kind != "assign"]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# --- features -------------------------------------------------------------

SPACE, DIGIT, HEXLOW, LOW, UP, ASSIGNS, QUOTE, OTHER = (1 << i for i in range(8))


def _class(b: int) -> int:
    c = chr(b)
    if b in (32, 9, 10, 11, 12, 13):
        return SPACE
    if c.isdigit() and b < 128:
        return DIGIT
    if "a" <= c <= "f":
        return HEXLOW
    if "a" <= c <= "z" or b >= 128:
        return LOW
    if "A" <= c <= "Z":
        return UP
    return ASSIGNS if c in "=:" else QUOTE if c in "\"'" else OTHER


_CLASS = np.array([_class(b) for b in range(256)], np.uint8)
#: Classes whose changes within a token count: small letters, capitals, digits, others.
_GROUP = np.select([_CLASS & (HEXLOW | LOW) > 0, _CLASS == UP, _CLASS == DIGIT], [1, 2, 3], 0).astype(np.int8)
_LENGTHS = np.array([4, 8, 16, 24, 32])
_SHARES = np.array([0.01, 1 / 3, 3 / 4])
_CHANGES = np.array([1, 2, 4, 8, 12])


def _shape_features(flags: int, length: int, share: int) -> list[bool]:
    has = lambda c: bool(flags & c)
    letters = has(HEXLOW | LOW | UP)
    return [
        True,
        *(length == i for i in range(6)),
        *(share == i for i in range(4)),
        has(DIGIT) and letters,
        has(DIGIT) and has(UP) and not has(HEXLOW | LOW),
        has(DIGIT) and has(HEXLOW) and not has(LOW | UP),
        has(UP) and has(HEXLOW | LOW) and has(DIGIT),
        length >= 3 and has(DIGIT) and letters,
        has(ASSIGNS),
        has(ASSIGNS) and has(DIGIT) and length >= 2,
        has(QUOTE),
        has(OTHER),
        not letters,
    ]


#: Rows by (flags without SPACE, length, share).
SHAPES = np.array([_shape_features(f << 1, n, s) for f in range(128) for n in range(6) for s in range(4)], np.float64)
#: Rows by (changes of class, length, has OTHER).
MIXES = np.array([[c == i and n == j and o == k for i in range(6) for j in range(6) for k in range(2)] for c in range(6) for n in range(6) for o in range(2)], np.float64)
#: Around a token: before has = or :, before is a keyword, after has = or :, digits before, digits after, keyword itself; the text has many digits, is short.
AROUND = np.array([[bool(i >> b & 1) for b in range(8)] for i in range(256)], np.float64)
#: Words are told apart by the letters among their first STEM bytes, by so many values; 0 is a token without letters or none.
WORDS, STEM = 1024, 6
_LETTERS = (_GROUP == 1) | (_GROUP == 2)
#: What a token is described by, and the features of each value; words are features themselves.
VIEWS: dict[str, np.ndarray | None] = {"shape": SHAPES, "mix": MIXES, "around": AROUND, "before": None, "second": None, "after": None}
N_FEATURES = sum(WORDS if t is None else t.shape[1] for t in VIEWS.values())

Codes = dict[str, np.ndarray]


def token_features(texts: list[bytes], whole: list[tuple[bool, bool]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """(text number, start, end, codes by view) of every white-space token of the texts.

    ``whole`` has what the last two features of AROUND are, for texts that were cut out of others.
    """
    joined = b"\n".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    classes = _CLASS[raw]
    blank = np.concatenate([[True], classes == SPACE])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, dict.fromkeys(VIEWS, none)
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    bases = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    which = np.searchsorted(bases, starts, side="right") - 1
    lengths = ends - starts
    flags = np.bitwise_or.reduceat(classes, starts)
    digits = np.add.reduceat((classes == DIGIT).astype(np.int32), starts)
    size = np.searchsorted(_LENGTHS, lengths, side="right")
    shape = ((flags >> 1).astype(np.int64) * 6 + size) * 4 + np.searchsorted(_SHARES, digits / lengths, side="right")
    group = _GROUP[raw]
    changed = np.concatenate([[False], group[1:] != group[:-1]]) & ~blank[:-1] & ~blank[1:]
    changes = np.add.reduceat(changed.astype(np.int32), starts)
    mix = (np.searchsorted(_CHANGES, changes, side="right") * 6 + size) * 2 + ((flags & OTHER) > 0)
    keyword = np.zeros(len(starts), bool)
    low = joined.lower()
    for k in KEYWORDS:
        at = low.find(k)
        while at >= 0:
            keyword[np.searchsorted(starts, at, side="right") - 1] = True
            at = low.find(k, at + 1)
    word, small = np.zeros(len(starts), np.uint64), np.frombuffer(low, np.uint8)
    for i in range(STEM):
        at = starts + i
        inside = at < ends
        at[~inside] = 0
        letter = inside & _LETTERS[small[at]]
        word = np.where(letter, word * np.uint64(257) + small[at], word)
    word = np.where(word > 0, 1 + (word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (WORDS - 1), 0)
    first = np.concatenate([[True], which[1:] != which[:-1]])
    last = np.concatenate([first[1:], [True]])
    before = lambda x: np.where(first, 0, np.concatenate([x[:1], x[:-1]]))
    after = lambda x: np.where(last, 0, np.concatenate([x[1:], x[-1:]]))
    assigns, numeric = (flags & ASSIGNS) > 0, (flags & DIGIT) > 0
    if whole is None:
        count = np.bincount(which, minlength=len(texts))
        heavy, short = np.bincount(which, numeric, minlength=len(texts)) > 0.1 * count, count < 50
    else:
        heavy, short = (np.array([w[i] for w in whole], bool) for i in (0, 1))
    around = [before(assigns), before(keyword), after(assigns), before(numeric), after(numeric), keyword, heavy[which], short[which]]
    code = np.zeros(len(starts), np.int64)
    for i, a in enumerate(around):
        code |= a.astype(np.int64) << i
    codes = {"shape": shape, "mix": mix.astype(np.int64), "around": code, "before": before(word), "second": before(before(word)), "after": after(word)}
    return which, starts - bases[which], ends - bases[which], codes


# --- the model ------------------------------------------------------------

OUT, BEGIN, INSIDE = range(3)


class Crf:
    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        """``weights``: (N_FEATURES, 3); ``moves``: what each step from tag to tag adds."""
        self.moves = moves.astype(np.float64)
        self.by_code, at = {}, 0
        for name, table in VIEWS.items():
            width = WORDS if table is None else table.shape[1]
            part = weights[at : at + width]
            self.by_code[name] = part if table is None else table @ part
            at += width
        #: By tag, what it can gain over outside from the steps to and from it.
        self.lead = (moves - moves[:, [OUT]]).max(0) + (moves - moves[[OUT]]).max(1)

    def scores(self, codes: Codes) -> np.ndarray:
        return sum(self.by_code[name][codes[name]] for name in VIEWS)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags of a stretch between two outside tokens."""
        total, back = scores[0] + self.moves[OUT], []
        for s in scores[1:]:
            ways = total[:, None] + self.moves
            back.append(ways.argmax(0))
            total = ways.max(0) + s
        tags = [int((total + self.moves[:, OUT]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tags(self, which: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Tags of all tokens; texts begin and end as if outside tokens stood around them."""
        out = np.zeros(len(scores), np.int8)
        unsure = np.flatnonzero((scores[:, 1:] + self.lead[1:] >= scores[:, [OUT]]).any(1))
        if not len(unsure):
            return out
        cuts = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(which[unsure]) > 0)) + 1
        edges = np.concatenate([[0], cuts, [len(unsure)]])
        single = edges[:-1][np.diff(edges) == 1]
        alone = unsure[single]
        out[alone] = (scores[alone] + self.moves[OUT] + self.moves[:, OUT]).argmax(1)
        for a, b in pairwise(edges):
            if b - a > 1:
                out[unsure[a:b]] = self.viterbi(scores[unsure[a:b]])
        return out


def likelihood(weights: np.ndarray, moves: np.ndarray, codes: Codes, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood, gradients) over windows (windows, tokens), tags -1 where a window has ended; each begins after an outside token."""
    live = tags >= 0
    gold = np.eye(3)[np.maximum(tags, 0)] * live[..., None]
    model = Crf(weights, moves)
    e = model.scores(codes)
    value = float((gold * e).sum())
    top = e.max(2, keepdims=True)
    fit, step = np.where(live[..., None], np.exp(e - top), 1.0), np.exp(moves)
    n, length = tags.shape
    f, scale = np.zeros((n, length, 3)), np.ones((n, length))
    a = fit[:, 0] * step[OUT]
    for t in range(length):
        if t:
            a = np.where(live[:, t, None], (f[:, t - 1] @ step) * fit[:, t], f[:, t - 1])
        scale[:, t] = a.sum(1)
        f[:, t] = a / scale[:, t, None]
    b = np.ones((n, length, 3))
    joint = np.zeros((3, 3))
    for t in range(length - 1, 0, -1):
        right = fit[:, t] * b[:, t] / scale[:, t, None]
        on = live[:, t]
        joint += step * (f[on, t - 1].T @ right[on])
        b[:, t - 1] = np.where(on[:, None], right @ step.T, b[:, t])
    p = f * b
    p /= p.sum(2, keepdims=True)
    p *= live[..., None]
    pairs = np.einsum("wti,wtj->ij", gold[:, :-1], gold[:, 1:])
    pairs[OUT] += gold[:, 0].sum(0)
    joint[OUT] += p[:, 0].sum(0)
    value += float((pairs * moves).sum()) - float((np.log(scale) + np.where(live, top[..., 0], 0.0))[live].sum())
    rest, grads = (gold - p)[live], []
    for name, table in VIEWS.items():
        c = codes[name][live]
        width = WORDS if table is None else len(table)
        by_code = np.stack([np.bincount(c, rest[:, i], minlength=width) for i in range(3)], 1)
        grads.append(by_code if table is None else table.T @ by_code)
    return value, np.concatenate(grads), pairs - joint


def fit(codes: Codes, tags: np.ndarray, *, steps: int = 150, rate: float = 0.1, decay: float = 2e-4) -> Crf:
    """Maximum likelihood by gradient steps (Adam)."""
    params = np.zeros((N_FEATURES + 3, 3))
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for k in range(1, steps + 1):
        _, by_weight, by_move = likelihood(params[:-3], params[-3:], codes, tags)
        grad = np.concatenate([by_weight, by_move]) / max(1, len(tags)) - decay * params
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        params = params + rate * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.999**k)) + 1e-8)
    return Crf(params[:-3], params[-3:])


def nothing_learned() -> Crf:
    """Tags every token as outside: for a sample without any match."""
    w = np.zeros((N_FEATURES, 3))
    w[0, OUT] = 10.0
    return Crf(w, np.zeros((3, 3)))


# --- training -------------------------------------------------------------

WIDTH = 16
_PER_TEXT, _VARIANTS = 3, 3
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LEADS = ("with", "is", "use", "-", "key", "the key", "bearer", "login", "auth", "=>", "->", "credential", "pass", "signed", "password is", "passwd -", "the secret", "token is", "")


def made_secret(rng: random.Random) -> str:
    n = rng.randrange(16, 56)
    body = lambda letters: "".join(rng.choice(letters) for _ in range(n))
    form = rng.randrange(6)
    if form == 0:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 6))) + rng.choice("_-.") + body(_ALNUM)
    if form == 1:
        return body(_ALNUM + "+/") + rng.choice(("", "=", "=="))
    if form == 2:
        return body("0123456789abcdef")
    if form == 3:
        return body("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    if form == 4:
        short = [rng.choice(_ALNUM) for _ in range(rng.randrange(11, 22))]
        short.insert(rng.randrange(1, len(short)), rng.choice("!@#$%^&*"))
        return "".join(short)
    return body(_ALNUM)


def made_plain(rng: random.Random, words: list[str]) -> str:
    """Odd tokens that are no secrets."""
    word = lambda: re.sub(r"\W|\d|_", "", rng.choice(words)) or "name"
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [
            lambda: f"https://{word()}.example/{word()}/{word()}{d(2)}?id={d(4)}",
            lambda: f"{word()}.{word()}{d(2)}@{word()}.example",
            lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T0{d(1)}:{d(2)}:{d(2)}Z",
            lambda: ".".join(d(rng.randrange(1, 4)) for _ in range(4)),
            lambda: f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}",
            lambda: d(rng.randrange(6, 20)),
            lambda: f"{d(1)}.{d(rng.randrange(3, 14))}",
            lambda: f"{word().lower()}_{word().lower()}_{word().lower()}{d(1)}",
            lambda: word().lower() + word().capitalize() + word().capitalize() + d(1),
            lambda: f"v{d(1)}.{d(2)}.{d(1)}-rc{d(1)}",
            lambda: f"/{word()}/{word()}-{d(1)}/{word()}.{word()[:3]}",
            lambda: word() + word() + word(),
            lambda: rng.choice(("token", "secret", "password", "key", "login", "bearer")),
        ]
    )()


def examples(text: str, seed: int) -> Iterator[tuple[list[str], list[int]]]:
    """Training windows: (tokens, tags)."""
    rng = random.Random(seed)
    tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    words = [text[a:b] for a, b in tokens]
    if not words:
        return
    tags = [OUT] * len(words)
    starts = [a for a, _ in tokens]
    values = values_of(text)
    for a, b in values:
        i = max(0, bisect_right(starts, a) - 1)
        tags[i] = BEGIN
        while (i := i + 1) < len(words) and starts[i] < b:
            tags[i] = INSIDE

    def window(i: int) -> tuple[int, int]:
        lo = max(0, min(i - WIDTH // 2, len(words) - WIDTH))
        return lo, min(len(words), lo + WIDTH)

    def put(i: int, j: int, new: list[str], marks: list[int]) -> tuple[list[str], list[int]]:
        """The window with the tokens from i up to j replaced."""
        lo, hi = max(0, i - WIDTH // 2), min(len(words), j + WIDTH // 2)
        w, t = words[lo:i] + new + words[j:hi], tags[lo:i] + marks + tags[j:hi]
        return w[:WIDTH], t[:WIDTH]

    def secret() -> tuple[list[str], list[int]]:
        s = rng.choice(('"{}"', "{}", "{}", "'{}'", "{},", "({})")).format(made_secret(rng))
        if rng.random() < 0.2:
            k = rng.randrange(2, 5)
            cut = [s[len(s) * i // k : len(s) * (i + 1) // k] for i in range(k)]
            return cut, [BEGIN] + [INSIDE] * (k - 1)
        return [s], [BEGIN]

    for i in [i for i, t in enumerate(tags) if t == BEGIN][:_PER_TEXT]:
        lo, hi = window(i)
        yield words[lo:hi], tags[lo:hi]
        end = i + 1
        while end < len(words) and tags[end] == INSIDE:
            end += 1
        cue = i
        while cue > 0 and i - cue < 3 and (re.search(r"[=:]$", words[cue - 1]) or any(k in words[cue - 1].lower() for k in ("password", "passwd", "secret", "token", "api"))):
            cue -= 1
        yield put(i, end, *secret())
        yield put(cue, end, words[i:end], tags[i:end])
        yield put(cue, end, *secret())
        for _ in range(_VARIANTS):
            value, marks = secret()
            lead = rng.choice(_LEADS).split()
            yield put(cue, end, lead + value, [OUT] * len(lead) + marks)
    odd = [i for i, w in enumerate(words) if tags[i] == OUT and (re.search(r"\d", w) or len(w) > 24)]
    for i in rng.sample(odd, min(_PER_TEXT, len(odd))) + [rng.randrange(len(words))]:
        lo, hi = window(i)
        yield words[lo:hi], tags[lo:hi]
    i = rng.randrange(len(words))
    plain = [made_plain(rng, words) for _ in range(3)]
    if rng.random() < 0.3:
        plain = [*rng.choice(_LEADS).split(), *plain]
    yield put(i, i, plain, [OUT] * len(plain))
    i = rng.randrange(len(words) + 1)
    value, marks = secret()
    lead = rng.choice(_LEADS).split()
    yield put(i, i, lead + value, [OUT] * len(lead) + marks)


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags and codes of the training windows of the sampled texts."""
    for b in batches:
        texts, tagged, whole = [], [], []
        for text, h in zip(each_text(b), b.column("h").to_pylist(), strict=True):
            string = text.decode("utf-8", "replace")
            words = text.split()
            facts = sum(any(48 <= c <= 57 for c in w) for w in words) > 0.1 * len(words), len(words) < 50
            for w, t in examples(string, h):
                texts.append(" ".join(w).encode())
                tagged.append(t)
                whole.append(facts)
        which, _, _, codes = token_features(texts, whole)
        edges = np.searchsorted(which, np.arange(len(texts) + 1))
        kind = pa.list_(pa.int32())
        made = [pa.array([codes[v][i:j].tolist() for i, j in pairwise(edges)], kind) for v in VIEWS]
        yield pa.RecordBatch.from_arrays([pa.array(tagged, kind), *made], ["tags", *VIEWS])


#: For the sample only: texts that hold a match, more or less.
_LIKELY = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|(?-i)AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""


def train(docs: DataFrame, *, sample: int = 1000) -> Crf:
    """The CRF, from at most ``sample`` rows with a match and as many without, chosen by a hash of the row.

    The windows that reach the driver are at most two dozen of WIDTH tokens for each of them.
    """
    likely = F.coalesce(F.col("text").rlike(_LIKELY), F.lit(False))
    marks = scratch(docs.select(F.xxhash64("doc_id", "text").alias("h"), likely.alias("likely")), "marks")
    with_match, without = (marks.where(F.col("likely") == k).select("h").distinct().orderBy("h").limit(sample) for k in (True, False))
    texts = docs.select(utf8(F.col("text")).alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    picked = texts.join(F.broadcast(with_match.unionByName(without)), "h", "left_semi").dropDuplicates(["h"])
    rows = picked.mapInArrow(_windows, ", ".join(f"{c} array<int>" for c in ("tags", *VIEWS))).toArrow()
    if not rows.num_rows:
        return nothing_learned()
    grids = {}
    for name in rows.column_names:
        fill = -1 if name == "tags" else 0
        grids[name] = np.array([x + [fill] * (WIDTH - len(x)) for x in rows.column(name).to_pylist()], np.int64)
    order = np.lexsort(np.concatenate(list(grids.values()), axis=1).T)
    grids = {name: g[order] for name, g in grids.items()}
    tags = grids.pop("tags")
    if not (tags > 0).any():
        return nothing_learned()
    return fit(grids, tags)


# --- scanning -------------------------------------------------------------

_CHUNK = 4_000_000
#: Signs at a token's ends that do not belong to a secret.
_EDGES = b"\"'`,;:()[]{}<>.!?|"


def crf_spans(crf: Crf, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans of each text that the CRF tags."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    which, starts, ends, codes = token_features(texts)
    if not len(which):
        return found
    tags = crf.tags(which, crf.scores(codes))
    previous = -2
    for i in np.flatnonzero(tags):
        own = found[which[i]]
        if tags[i] == INSIDE and previous == i - 1 and own:
            own[-1] = own[-1][0], int(ends[i])
        else:
            own.append((int(starts[i]), int(ends[i])))
        previous = i
    return [[s for a, b in own if (s := _trimmed(text, a, b))] for text, own in zip(texts, found, strict=True)]


def _trimmed(text: bytes, a: int, b: int) -> tuple[int, int] | None:
    inner = text[a:b]
    left = len(inner) - len(inner.lstrip(_EDGES))
    inner = inner.strip(_EDGES)
    return (a + left, a + left + len(inner)) if inner else None


def all_spans(text: bytes, tagged: list[tuple[int, int]]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) in code points; ``tagged`` are byte spans in order."""
    string = text.decode("utf-8", "replace")
    base = base_spans(string)
    if not tagged:
        return base, base
    if len(string) != len(text):
        points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        tagged = [(int(points[a]) - 1, int(points[b - 1])) for a, b in tagged]
    starts, reach = [a for a, _, _ in base], []
    for _, b, _ in base:
        reach.append(max(b, reach[-1]) if reach else b)
    extra = []
    for a, b in tagged:
        i = bisect_right(starts, b - 1)  # base spans that start before this one ends
        if not i or reach[i - 1] <= a:
            extra.append((a, b, "crf"))
    return base, ordered(base + extra)


def _scanner(crf: Crf):
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    types = [pa.int64()] * 4 + [pa.string()] * 2

    def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
        chunk, size = [], 0
        for t in texts:
            if chunk and size + len(t) > _CHUNK:
                yield chunk
                chunk, size = [], 0
            chunk.append(t)
            size += len(t)
        if chunk:
            yield chunk

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for texts in chunks(list(each_text(b))):
                for text, tagged in zip(texts, crf_spans(crf, texts), strict=True):
                    base, spans = all_spans(text, tagged)
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            made = zip(*rows, strict=True) if rows else [[] for _ in columns[1:]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(made, types[1:], strict=True))], columns)

    return run


def scan_secrets(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return texts.mapInArrow(_scanner(crf), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
