"""String similarity: longest common subsequence, in blocks.

``ratio`` is 200 * LCS / (sum of lengths). The bit-parallel LCS runs for one string against a whole block at once: the
block holds character codes by place, and each place advances the bit vectors of all strings that reach it together, in NumPy;
strings over 64 characters have several words of bits each, with carries. A block takes memory in proportion to its characters. The
set and partial scorers build on the same LCS: shared tokens are looked up in an inverted index of the block and count without any LCS,
and the windows of partial scores advance side by side, those alone that share enough characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCORERS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "WRatio")
#: Scorers that a difference in length bounds from above.
LENGTH_BOUND = ("ratio", "token_sort_ratio")
#: A character or token that one in so many of a block's strings has is looked up in a row of all strings, not in a list of those.
COMMON = 8


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if m := at.get(ch):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def sort_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(sort_tokens(a), sort_tokens(b))


def _parts(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    join = lambda s: " ".join(sorted(s))
    return join(x & y), join(x - y), join(y - x)


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _parts(a, b)
    if both and not (left and right):
        return 100.0
    glue = lambda s: f"{both} {s}" if both else s
    best = ratio(glue(left), glue(right))
    return max(best, ratio(both, glue(left)), ratio(both, glue(right))) if both else best


def partial_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    m, n = len(short), len(long)
    windows = {long[max(0, i) : i + m] for i in range(1 - m, n)}
    best = max(ratio(short, w) for w in windows)
    if m == n:
        best = max(best, max(ratio(long, w) for w in {short[max(0, i) : i + m] for i in range(1 - m, m)}))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _parts(a, b)
    if both:
        return 100.0
    best = partial_ratio(sort_tokens(a), sort_tokens(b))
    return max(best, partial_ratio(left, right))


def wratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if lengths < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


BY_NAME: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "WRatio": wratio,
}


def scorer(name: str) -> Callable[[str, str], float]:
    """An unknown name means token_sort_ratio."""
    return BY_NAME.get(name, token_sort_ratio)


class Block:
    """Strings to be compared with many others."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.order = np.argsort(-self.lengths, kind="stable")
        width = int(self.lengths.max(initial=0))
        letters = sorted(set().union(*texts))
        self.code = {ch: i + 1 for i, ch in enumerate(letters)}
        points = np.array([ord(ch) for ch in letters], np.int64)
        # How many strings reach each place: those after them need no more steps.
        self.reach = np.searchsorted(-self.lengths[self.order], -np.arange(1, width + 1), "right")
        self.start = np.concatenate([[0], np.cumsum(self.reach)])
        # Codes by place, the longest strings first, and of each place only the strings that reach it.
        self.flat = np.empty(int(self.start[-1]), np.int32)
        bag: tuple[list, list, list] = ([], [], [])
        for k, i in enumerate(self.order):
            codes = np.searchsorted(points, np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4")) + 1
            self.flat[self.start[: len(codes)] + k] = codes
            kinds, counts = np.unique(codes, return_counts=True)
            bag[0].append(kinds)
            bag[1].append(np.full(len(kinds), i))
            bag[2].append(counts)
        # For each character the strings that have it, and how often.
        kinds, owners, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in bag)
        by = np.argsort(kinds, kind="stable")
        self.owners, self.counts = owners[by], counts[by].astype(np.int32)
        self.of = np.searchsorted(kinds[by], np.arange(len(letters) + 2))
        # What many strings have is faster to add up in a row of all strings.
        self.whole: dict[int, np.ndarray] = {}
        for c in np.flatnonzero(np.diff(self.of) * COMMON >= len(texts)) if texts else ():
            held = slice(self.of[c], self.of[c + 1])
            self.whole[int(c)] = np.zeros(len(texts), np.int32)
            self.whole[int(c)][self.owners[held]] = self.counts[held]

    def lcs_bound(self, a: str) -> np.ndarray:
        """Shared characters, however placed: no LCS is longer."""
        out = np.zeros(len(self.texts), np.int32)
        for ch, n in Counter(a).items():
            if c := self.code.get(ch):
                if c in self.whole:
                    out += np.minimum(self.whole[c], n)
                    continue
                held = slice(self.of[c], self.of[c + 1])
                out[self.owners[held]] += np.minimum(self.counts[held], n)  # a string has a character once here
        return out

    def lcs(self, a: str, wanted: np.ndarray) -> np.ndarray:
        """Of a and each wanted string; the others get 0."""
        out = np.zeros(len(self.texts), np.int64)
        if not a or not wanted.any():
            return out
        words, n = -(-len(a) // 64), int(wanted.sum())
        if n * (16 + words) < 256 * words:  # few strings for so many words: integers of any width take less
            for i in np.flatnonzero(wanted):
                out[i] = lcs(a, self.texts[i])
            return out
        row_of, table = self._rows(a)
        places = np.flatnonzero(wanted[self.order])
        reach = np.searchsorted(places, self.reach)
        full = [np.uint64((1 << min(64, len(a) - 64 * w)) - 1) for w in range(words)]
        v = np.repeat(np.array(full, np.uint64)[:, None], len(places), 1)
        for j in range(len(self.reach)):
            if not (n := int(reach[j])):
                break
            _advance(v[:, :n], table[:, row_of[self.flat[self.start[j] + places[:n]]]])
        left = sum(np.bitwise_count(v[w] & full[w]).astype(np.int64) for w in range(words))
        out[self.order[places]] = len(a) - left
        return out

    def _rows(self, a: str) -> tuple[np.ndarray, np.ndarray]:
        """A row for each character of a that the block has, by the block's codes, row 0 for all others; and the rows' bits in a."""
        used: dict[int, int] = {0: 0}
        table = np.zeros((-(-len(a) // 64), len(set(a)) + 1), np.uint64)
        row_of = np.zeros(len(self.code) + 1, np.int64)
        for i, ch in enumerate(a):
            if c := self.code.get(ch):
                row_of[c] = used.setdefault(c, len(used))
                table[i // 64, row_of[c]] |= np.uint64(1 << i % 64)
        return row_of, table

    @cached_property
    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all strings one after the other, and where each begins."""
        starts = np.cumsum(self.lengths) - self.lengths
        codes = np.zeros(int(self.lengths.sum()), np.int32)
        for j, n in enumerate(self.reach):
            codes[starts[self.order[:n]] + j] = self.flat[self.start[j] : self.start[j] + n]
        return codes, starts

    def partials(self, a: str, least: float) -> np.ndarray:
        """partial_ratio of a and each string; 0 where it is below least."""
        if not a:
            return np.where(self.lengths == 0, 100.0, 0.0) * (least <= 100)
        out = np.zeros(len(self.texts))
        long = np.flatnonzero(self.lengths >= len(a))
        out[long] = self._windows_of_strings(a, long, least)
        for n in np.unique(self.lengths[(self.lengths > 0) & (self.lengths <= len(a))]):
            some = np.flatnonzero(self.lengths == n)
            out[some] = np.maximum(out[some], self._windows_of(a, some, int(n), least))
        return np.where(out >= least, out, 0.0)

    def _windows_of_strings(self, a: str, some: np.ndarray, least: float) -> np.ndarray:
        """Of strings no shorter than a: the best ratio of a and a window as long as it, or cut off at either end."""
        best = np.zeros(len(some))
        if not len(some):
            return best
        m, n = len(a), self.lengths[some]
        codes, starts = self._joined
        row_of, table = self._rows(a)
        room = n + 2 * (m - 1)  # with a window's length of nothing on both sides
        at = np.cumsum(room) - room
        rows = np.zeros(int(room.sum()), np.int64)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows[np.repeat(at + m - 1, n) + within] = row_of[codes[np.repeat(starts[some], n) + within]]
        windows = n + m - 1
        owner = np.repeat(np.arange(len(some)), windows)
        k = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        first = np.repeat(at, windows) + k
        size = np.minimum(np.minimum(k + 1, m), np.repeat(windows, windows) - k)
        shared = np.zeros(len(first), np.int64)
        for ch, count in Counter(a).items():
            if (c := self.code.get(ch)) and (r := row_of[c]):
                so_far = np.concatenate([[0], np.cumsum(rows == r)])
                shared += np.minimum(so_far[first + m] - so_far[first], count)
        may = np.flatnonzero(200.0 * shared >= (least - 1e-4) * (m + size))
        if not len(may):
            return best
        words = len(table)
        full = [np.uint64((1 << min(64, m - 64 * w)) - 1) for w in range(words)]
        for part in np.array_split(may, -(-len(may) // 500_000)):
            v = np.repeat(np.array(full, np.uint64)[:, None], len(part), 1)
            for j in range(m):
                _advance(v, table[:, rows[first[part] + j]])
            found = m - sum(np.bitwise_count(v[w] & full[w]).astype(np.int64) for w in range(words))
            np.maximum.at(best, owner[part], 200.0 * found / (m + size[part]))
        return best

    def _windows_of(self, a: str, some: np.ndarray, n: int, least: float) -> np.ndarray:
        """Of strings of n characters, no more than a has: the best ratio of one and a window of a."""
        codes, starts = self._joined
        row_of, table = self._rows(a)
        rows = row_of[codes[starts[some][:, None] + np.arange(n)]]
        k = np.arange(len(a) + n - 1)
        lo, hi = np.maximum(0, k - n + 1), np.minimum(len(a), k + 1)
        shared = np.zeros((len(some), len(k)), np.int64)
        own = np.array([row_of[self.code.get(ch, 0)] for ch in a])
        for r in np.unique(own[own > 0]):
            so_far = np.concatenate([[0], np.cumsum(own == r)])
            shared += np.minimum((rows == r).sum(1)[:, None], (so_far[hi] - so_far[lo])[None])
        who, which = np.nonzero(200.0 * shared >= (least - 1e-4) * (n + hi - lo)[None])
        best = np.zeros(len(some))
        if not len(who):
            return best
        if len(a) <= 64:
            shift = lo[which].astype(np.uint64)
            bits = (hi - lo)[which].astype(np.uint64)
            full = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(bits, np.uint64(63))) - np.uint64(1))
            v = full.copy()[None]
            for j in range(n):
                _advance(v, ((table[0, rows[who, j]] >> shift) & full)[None])
            found = (hi - lo)[which] - np.bitwise_count(v[0] & full).astype(np.int64)
        else:
            found = np.array([lcs(self.texts[some[i]], a[lo[w] : hi[w]]) for i, w in zip(who, which)])
        np.maximum.at(best, who, 200.0 * found / (n + hi - lo)[which])
        return best

    def ratios(self, a: str, least: float) -> np.ndarray:
        """ratio of a and each string; 0 where it is below least. Bounds are held against least less a rounding margin."""
        total = self.lengths + len(a)
        margin = least - 1e-4
        if not a:
            return np.where(total == 0, 100.0, 0.0) * (least <= 100)
        with np.errstate(divide="ignore", invalid="ignore"):
            wanted = 200.0 * np.minimum(self.lengths, len(a)) >= margin * total
            wanted &= 200.0 * self.lcs_bound(a) >= margin * total
            score = np.where(total > 0, 200.0 * self.lcs(a, wanted) / np.maximum(total, 1), 100.0)
        return np.where(wanted & (score >= least), score, 0.0)


def _advance(v: np.ndarray, hit: np.ndarray) -> None:
    """One step of the bit-parallel LCS for all strings: v and hit have the words of a string's bits, one below the other."""
    carry = None
    for w in range(len(v)):
        x = v[w]
        u = x & hit[w]
        total = x + u
        if w + 1 < len(v) or carry is not None:
            over = total < x
            if carry is not None:
                total = total + carry
                over |= total < carry
            carry = over.astype(np.uint64)
        v[w] = total | (x & ~u)


#: What sets of tokens don't share is short and comes again and again.
_known_lcs = lru_cache(maxsize=1 << 16)(lcs)


def set_form(s: str) -> str:
    return " ".join(sorted(set(s.split())))


class Forms:
    """A block's strings as they are, and with their tokens sorted, or made a set and sorted."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    raw = cached_property(lambda self: Block(self.texts))
    sorted = cached_property(lambda self: Block([sort_tokens(t) for t in self.texts]))
    sets = cached_property(lambda self: Block([set_form(t) for t in self.texts]))

    @cached_property
    def tokens(self) -> list[frozenset[str]]:
        return [frozenset(t.split()) for t in self.texts]

    @cached_property
    def index(self) -> dict[str, np.ndarray]:
        """For each token the strings that have it; for a common one a row of all strings, with what it counts."""
        at: dict[str, list[int]] = {}
        for i, own in enumerate(self.tokens):
            for token in own:
                at.setdefault(token, []).append(i)
        out = {}
        for token, x in at.items():
            out[token] = np.array(x)
            if len(x) * COMMON >= len(self.texts):
                out[token] = np.zeros(len(self.texts), np.int32)
                out[token][x] = len(token) + 1
        return out

    def shared(self, a: str) -> np.ndarray:
        """Characters of the tokens that a and each string share, joined by blanks."""
        out = np.zeros(len(self.texts), np.int32)
        for token in set(a.split()):
            if (at := self.index.get(token)) is None:
                continue
            if at.dtype == np.int32:
                out += at
            else:
                out[at] += len(token) + 1
        return np.maximum(out - 1, 0)

    def token_sets(self, a: str, least: float) -> np.ndarray:
        """token_set_ratio of a and each string; 0 where it is below least. What the shared tokens alone score against the shorter side is
        known from their length; the LCS of the rest is only needed where lengths and characters allow more than that."""
        score, own, size = np.zeros(len(self.texts)), set(a.split()), self.sets.lengths
        if not own:
            return score
        form, margin = set_form(a), least - 1e-4
        n, both = len(form), self.shared(a)
        short = np.minimum(size, n)
        some = np.flatnonzero((200.0 - margin) * both >= margin * short)  # if 200 * both / (both + short) reaches the least score
        some = some[both[some] > 0]
        score[some] = 200.0 * both[some] / (both[some] + short[some])
        may = 200.0 * short >= margin * (size + n)
        may &= (size > 0) & (score < 100)
        if may.any():
            total, bound = size + n, 200.0 * self.sets.lcs_bound(form)
            may &= (bound >= margin * total) & (bound > score * total)
            apart = may & (both == 0)
            if apart.any():
                score[apart] = (200.0 * self.sets.lcs(form, apart) / np.maximum(total, 1))[apart]
            tokens = sorted(own)
            for i in np.flatnonzero(may & (both > 0)):
                left, right = " ".join(t for t in tokens if t not in self.tokens[i]), " ".join(sorted(self.tokens[i] - own))
                score[i] = max(score[i], 200.0 * (both[i] + 1 + _known_lcs(left, right)) / total[i])
        return np.where((size > 0) & (score >= least), score, 0.0)

    def weighted(self, a: str, least: float) -> np.ndarray:
        """wratio of a and each string; 0 where it is below least."""
        lengths = self.raw.lengths
        if not a:
            return np.zeros(len(self.texts))
        apart = np.maximum(lengths, len(a)) / np.maximum(np.minimum(lengths, len(a)), 1)
        near, scale = apart < 1.5, np.where(apart <= 8, 0.9, 0.6)
        # What is scaled down has to reach more than the least score before.
        above = lambda by: least / by - 1e-6
        out = self.raw.ratios(a, least)
        if near.any():
            out = np.maximum(out, np.where(near, 0.95 * np.maximum(self.sorted.ratios(sort_tokens(a), above(0.95)), self.token_sets(a, above(0.95))), 0))
        if not near.all():
            tokens = np.maximum(self.sorted.partials(sort_tokens(a), above(0.855)), self.sets.partials(set_form(a), above(0.855)))
            tokens = np.where(self.shared(a) > 0, 100.0, tokens)
            out = np.maximum(out, np.where(near, 0, np.maximum(scale * self.raw.partials(a, above(0.9)), 0.95 * scale * tokens)))
        return np.where((lengths > 0) & (out >= least), out, 0.0)


def block_scores(name: str, forms: Forms, a: str, least: float) -> np.ndarray:
    """Scores of a against a block (of sorted tokens for token_sort_ratio); below least they are 0."""
    if name in LENGTH_BOUND:
        return forms.raw.ratios(a, least)
    if name == "token_set_ratio":
        return forms.token_sets(a, least)
    return forms.raw.partials(a, least) if name == "partial_ratio" else forms.weighted(a, least)


@lru_cache(maxsize=8)
def udf(name: str):
    """A scorer of two string columns, as an Arrow-batched function."""
    score = scorer(name)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def register(spark: SparkSession) -> None:
    """The scorers as SQL functions: ratio, partial_ratio, token_sort_ratio, token_set_ratio, wratio."""
    for name in SCORERS:
        spark.udf.register(name.lower(), udf(name))
