"""Periodic runs of words within a document, by seeds that are extended along diagonals.

A run is a maximal stretch of words with smallest period q and a length of at least max(LEAST, 2q). Words q apart agree in
it, so position i of the pair (i, i + q) moves along the diagonal of lag q for at least max(LEAST - q, q) words: the
overlap that is guaranteed. For lags below LEAST that is LEAST / 2 words at least, and for lags in [m, 2m) it is m. So for
each of these classes of lags the grams of just that length are indexed within their document, pairs of occurrences whose
distance is in the class are the seeds, and each is extended as far as words agree. A table of how far each lag has been
covered keeps later seeds of the same diagonal from being extended again.

Grams are named by doubling: the name of a gram of 2k words is the pair of the names of its halves, renumbered, so they are
exact. A gram that occurs once in its document is dropped, and with it all longer ones that hold it. In a run of a small
period p a gram of m > p words occurs every p words; two occurrences inside one such run can't be a seed of a run with a
larger smallest period (both periods would have a common divisor as period), so these pairs are passed over by position
rather than listed.

Documents go through in batches of whole texts and a text's memory is proportional to its words; nothing is shuffled.

Edge cases: a null or empty text has no words, no run and an empty rest; words are runs of characters other than white
space of ASCII; repeated rows are documents of their own; all other columns pass through, and those with the name of a
result are replaced. A document must fit in a worker's memory, at about 100 bytes a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import SPACES, small_batches

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Words of a batch that are searched at once; a longer document is searched alone.
WORDS_AT_ONCE = 100_000
#: Seeds that are listed at once.
SEEDS_AT_ONCE = 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))

_words = re.compile(f"[^{SPACES}]+").findall


class Grams:
    """Names of the grams of a length at the positions where their document has them at least twice; -1 elsewhere."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.size = 1
        self.names = _repeated(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words, np.arange(len(words)), len(words))

    def upto(self, size: int) -> Grams:
        """The grams of `size` words, from those of one word."""
        out, power, rest = None, self, size
        while True:
            if rest & 1:
                out = power if out is None else power.longer(out)
            rest >>= 1
            if not rest:
                return out
            power = power.longer(power)

    def longer(self, other: Grams) -> Grams:
        """The grams of this length followed by `other`'s, in the same documents: names tell documents apart."""
        out = object.__new__(Grams)
        out.size = self.size + other.size
        at = np.flatnonzero(self.names[: max(0, len(self.names) - self.size)] >= 0)
        at = at[other.names[at + self.size] >= 0]
        pair = self.names[at] * (int(other.names.max(initial=0)) + 1) + other.names[at + self.size]
        out.names = _repeated(pair, at, len(self.names))
        return out


def _repeated(keys: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    out = np.full(length, -1, dtype=np.int64)
    if len(keys):
        _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
        kept = times[name] > 1
        out[at[kept]] = name[kept]
    return out


def seeds(grams: Grams, low: int, high: int, covered: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lags and positions of pairs of one gram at a distance in [low, high), in parts by ascending position. `covered` has
    for each position the end of the run of a smaller period that holds the gram there (0: none): partners inside the same
    run are passed over."""
    at = np.flatnonzero(grams.names >= 0)
    if not len(at):
        return
    span = len(grams.names) + high + 1
    base = grams.names[at] * span
    key = np.sort(base + at)
    first = np.searchsorted(key, base + np.clip(covered[at] - grams.size + 1, at + low, at + high))
    number = np.searchsorted(key, base + at + high) - first
    ends, begin = np.cumsum(number), 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SEEDS_AT_ONCE, side="right")))
        part = number[begin:end]
        if total := int(part.sum()):
            own = np.repeat(np.arange(begin, end), part)
            partner = first[own] + np.arange(total) - np.repeat(np.cumsum(part) - part, part)
            lags, held = key[partner] % span - at[own], at[own]
            order = np.lexsort((held, lags))
            yield lags[order], held[order]
        begin = end


def _agree(words: np.ndarray, a: int, b: int, most: int, step: int) -> int:
    """Number of words, `most` at most, that agree from a and b on, going by `step` (1 or -1)."""
    done, size = 0, 16
    while done < most:
        n = min(size, most - done)
        if step > 0:
            differ = words[a + done : a + done + n] != words[b + done : b + done + n]
        else:
            differ = words[a - done - n + 1 : a - done + 1][::-1] != words[b - done - n + 1 : b - done + 1][::-1]
        where = int(differ.argmax())
        if differ[where]:
            return done + where
        done, size = done + n, 2 * size
    return done


def _shorter(lag: int) -> Iterator[int]:
    """The lag divided by each of its prime divisors: if a stretch of two lags has a smaller period, it has one of these."""
    rest, k = lag, 2
    while rest > 1:
        if k * k > rest:
            k = rest
        if rest % k == 0:
            yield lag // k
            while rest % k == 0:
                rest //= k
        k += 1


class Document:
    """The runs found so far in one document, and how far each lag has been covered."""

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []
        self.furthest: dict[int, int] = {}

    def extend(self, words: np.ndarray, begin: int, end: int, at: int, lag: int, least: int) -> None:
        """Extend the seed at `at` and `at + lag` within the document's words [begin, end); seeds of a lag come by position."""
        if at < self.furthest.get(lag, begin):
            return
        left = at - _agree(words, at - 1, at - 1 + lag, at - begin, -1)
        right = at + _agree(words, at, at + lag, end - lag - at, 1)
        self.furthest[lag] = right
        length = right - left + lag
        if length >= max(least, 2 * lag) and not any(_agree(words, left, left + p, length - p, 1) == length - p for p in _shorter(lag)):
            self.runs.append((left, length, lag))


def find(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by document, of documents whose words (as numbers) stand one after the other."""
    begins = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    found: dict[int, Document] = {}
    grams = Grams(words, doc).upto(least // 2)
    low, high, longest = 1, least, int(sizes.max(initial=0)) // 2
    covered = np.zeros(len(words), dtype=np.int64)
    while low <= longest and (grams.names >= 0).any():
        for lags, at in seeds(grams, low, high, covered):
            # A seed right behind another one of its lag lies in the same stretch of the diagonal.
            new = np.ones(len(at), dtype=bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(lags) != 0)
            for lag, i in zip(lags[new].tolist(), at[new].tolist(), strict=True):
                d = int(doc[i])
                found.setdefault(d, Document()).extend(words, int(begins[d]), int(begins[d + 1]), i, lag, least)
        low, high = high, 2 * high
        grams = grams.longer(grams)
        _cover(covered, found, grams.size)
    return {d: sorted(((s - int(begins[d]), n, p) for s, n, p in x.runs), key=lambda r: (r[0], r[2])) for d, x in found.items() if x.runs}


def _cover(covered: np.ndarray, found: dict[int, Document], size: int) -> None:
    """Note for each position the end of the run, of those found so far, that holds the next `size` words."""
    covered[:] = 0
    for x in found.values():
        for start, length, _ in x.runs:
            if length >= size:
                part = covered[start : start + length - size + 1]
                np.maximum(part, start + length, out=part)


def numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, and the number of words of each text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    words, _ = pd.factorize(np.array([w for t in texts for w in t], dtype=object)) if sizes.sum() else (np.zeros(0, dtype=np.int64), None)
    return words.astype(np.int64), sizes


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The text without the words that repeat a run's first period."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return " ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add `runs` (start, length and period of every run, by start and then period, counted in words) and `collapsed`, the
    words outside of repetitions, joined by one space."""
    if least < 2 or least % 2:
        raise ValueError(f"the least length of a run must be an even number of words, not {least}")
    keep = [c for c in small_batches(df).columns if c not in (runs, collapsed)]

    def parts(texts: list[str | None]) -> Iterator[list[list[str]]]:
        held, size = [], 0
        for t in texts:
            held.append(_words(t or ""))
            size += len(held[-1])
            if size >= WORDS_AT_ONCE:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words in parts(batch.column(batch.num_columns - 1).to_pylist()):
                found = find(*numbered(words), least)
                each = [found.get(i, []) for i in range(len(words))]
                flat = np.array([r for x in each for r in x], dtype=np.int64).reshape(-1, 3)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32))
                rest = pa.array([collapse(w, x) for w, x in zip(words, each, strict=True)], pa.string())
                part = batch.slice(at, len(words))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(offsets, fields), rest], names=[*keep, runs, collapsed])
                at += len(words)

    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*rows.schema.fields, T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)
