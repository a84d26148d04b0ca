"""LM scoring by a Katz backoff model of word pairs.

The probability of a word after another is d(c) * c / c1 if the pair was seen c times in training (c1: times the first
word was seen), and otherwise a(first) times the word's own probability, which backs off in the same way to the class of
unknown words. d(c) are Good-Turing discounts in Katz's form for c <= 5, and a(first) shares out exactly what the discounts
have freed, so the probabilities after each word sum to 1 over the vocabulary and the unknown class. A text starts from a
begin mark and ends with an end token.

Counts live in tables that are partitioned by a hash of the first word; first words with so many occurrences that they
would burden one part are dealt over several, and only their sums meet. The documents are held as blocks of local word
numbers. Each block asks the word table for counts and the pair table for pair counts, both as packed arrays, and then
scores its tokens. Words are identified by 64-bit hashes: for 10^9 distinct words the chance of any collision is 3 in 100.

Where Good-Turing discounts don't exist (a count-of-counts is 0, or a discount is outside of 0..1), fewer counts are
discounted; where none can be, half a count is taken off each of them. After a word whose pairs all escape discounting, one
more occurrence is added to c1, and that share is backed off.

Edge cases: a null or empty text is one end token; a null id counts as empty text for the fold; without training rows all
words are unknown (probability 1); repeated rows count repeatedly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import materialise, parallelism
from shelfspark.llm.packed import pack, split_by, spread, unpack

#: Text in a block, in bytes.
BLOCK_BYTES = 16_000_000
#: The largest count that is discounted.
K = 5
END_HASH, BEGIN = 0, np.uint64(0)
#: A first word is hot if it has more than this share of what a part has on average.
HOT_SHARE = 0.25

BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, hashes binary, tokens binary"


def build_blocks(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, held, text) to blocks: word hashes, and the tokens as numbers of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, held, lengths, tokens, size = [], [], [], [], 0
        words: dict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        words[b""]  # the end token: no word is empty

        def flush() -> pa.RecordBatch:
            hashes = np.array([END_HASH, *[xxhash.xxh64_intdigest(w) for w in list(words)[1:]]], dtype=np.uint64)
            values = [[task << 32 | number], [ids], [held], [lengths], [hashes.tobytes()], [pack(np.concatenate(tokens))]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["block", "doc_ids", "held", "lengths", "hashes", "tokens"])

        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = text.encode("utf-8", "replace").lower().split()
                tokens.append(np.array([*map(words.__getitem__, found), 0], dtype=np.uint32))
                ids.append(doc_id)
                held.append(out)
                lengths.append(len(found) + 1)
                size += len(text)
                if size >= block_bytes:
                    yield flush()
                    number += 1
                    ids, held, lengths, tokens, size = [], [], [], [], 0
                    words.clear()
                    words[b""]
        if ids:
            yield flush()

    return materialise(rows.select("doc_id", "held", "text").mapInArrow(run, BLOCK))


def discounts(n: list[int]) -> np.ndarray:
    """Counts of counts n[1..K+1] to the discounts d[0..K] (d[0] unused)."""
    d = np.ones(K + 1)
    for k in range(K, 0, -1):
        if n[1] and all(n[c] for c in range(1, k + 1)):
            common = (k + 1) * n[k + 1] / n[1]
            if common < 1:
                found = [((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) for c in range(1, k + 1)]
                if all(0 < x < 1 for x in found):
                    d[1 : k + 1] = found
                    return d
    d[1:] = [(c - 0.5) / c for c in range(1, K + 1)]
    return d


class WordModel:
    """Probabilities of single words from their counts: discounted, the rest for the class of unknown words."""

    def __init__(self, total: int, n: list[int]):
        self.total, self.d = total, discounts(n)
        freed = sum((1 - self.d[c]) * c * n[c] for c in range(1, K + 1))
        self.scale, self.unknown = (total, freed / total) if freed > 0 else (total + 1, 1 / (total + 1))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        known = self.d[np.minimum(counts, K + 1) % (K + 1)] * counts / max(1, self.scale)
        return np.where(counts > 0, np.where(counts > K, counts / max(1, self.scale), known), self.unknown)


def word_table(blocks: DataFrame, parts: int) -> DataFrame:
    """Counts of all words in training rows. Per block and part: global numbers and counts in the order in which the block
    has its words of that part; per part (block -1): total, distinct and counts of counts."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                hashes = np.frombuffer(row.hashes, dtype=np.uint64)
                tokens = unpack(row.tokens).astype(np.int64)
                train = np.repeat(~np.array(row.held, dtype=bool), row.lengths)
                counts = np.bincount(tokens[train], minlength=len(hashes))
                part = (spread(hashes) % np.uint64(parts)).astype(np.int64)
                out = [(p, row.block, hashes[at].tobytes(), pack(counts[at])) for p, at in split_by(part)]
                yield pd.DataFrame(out, columns=["part", "block", "hashes", "counts"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, dtype=np.uint64) for x in frame["hashes"]]
        distinct, place = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([unpack(x) for x in frame["counts"]]).astype(np.float64), minlength=len(distinct)).astype(np.int64)
        # Numbers grow as counts fall, so that frequent words get small numbers; 0 is the begin mark.
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.lexsort((distinct, -counts))] = np.arange(len(distinct))
        number = rank * parts + key[0] + 1
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        out = [(b, key[0], pack(number[at]), pack(counts[at]), None) for b, at in zip(frame["block"], np.split(place, cuts), strict=True)]
        tally = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[: K + 2]
        out.append((-1, key[0], None, None, [int(counts.sum()), int((counts > 0).sum()), *map(int, tally)]))
        return pd.DataFrame(out, columns=["block", "part", "first", "second", "tally"])

    asked = blocks.select("block", "held", "lengths", "hashes", "tokens").mapInPandas(ask, "part int, block long, hashes binary, counts binary")
    return materialise(asked.groupBy("part").applyInPandas(merge, ANSWER))


ANSWER = "block long, part int, first binary, second binary, tally array<long>"


class Block:
    """A block with the global numbers and counts of its words."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, parts: int):
        hashes = np.frombuffer(row["hashes"], dtype=np.uint64)
        part = (spread(hashes) % np.uint64(parts)).astype(np.int64)
        by_part = {p: (a, b) for p, a, b in zip(answers["part"], answers["first"], answers["second"], strict=True)}
        self.numbers, self.counts = np.zeros(len(hashes), dtype=np.uint64), np.zeros(len(hashes), dtype=np.int64)
        for p, at in split_by(part):
            self.numbers[at], self.counts[at] = unpack(by_part[p][0]), unpack(by_part[p][1])
        self.doc_ids, self.held, self.lengths = row["doc_ids"], np.array(row["held"], dtype=bool), np.array(row["lengths"], dtype=np.int64)
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.empty(len(self.tokens), dtype=np.int64)
        before[1:] = self.tokens[:-1]
        before[self.first] = len(hashes)  # the begin mark
        # Distinct pairs of local numbers, and the pair of each token.
        self.pairs, self.pair_of = np.unique(before * (len(hashes) + 1) + self.tokens, return_inverse=True)
        self.a, self.b = np.divmod(self.pairs, len(hashes) + 1)
        self.a_numbers = np.append(self.numbers, BEGIN)
        self.train = np.repeat(~self.held, self.lengths)

    def deal(self, a_counts: np.ndarray, total: int, parts: int) -> np.ndarray:
        """The part of each pair: by the first word, and for hot first words by a share of the second words as well."""
        shares = np.ceil(a_counts * parts / max(1, total * HOT_SHARE)).astype(np.uint64)[self.a]
        shares = np.clip(shares, 1, parts)
        a, b = self.a_numbers[self.a], self.numbers[self.b]
        return (spread(a + (spread(b) % shares) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)

    def hot(self, a_counts: np.ndarray, total: int, parts: int) -> np.ndarray:
        return a_counts * parts > total * HOT_SHARE


def score(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, held, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Rows with `held`
    are scored only; all others are learned from as well."""
    parts = parallelism(rows.sparkSession)
    blocks = build_blocks(rows, block_bytes)
    words = word_table(blocks, parts)
    tally = [int(x or 0) for x in words.filter("block = -1").select(*[F.sum(F.col("tally")[i]) for i in range(K + 4)]).first()]
    total, distinct, n = tally[0], tally[1], tally[2:]
    texts = int(blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0)
    model = WordModel(total, n)
    given = words.filter("block >= 0").drop("tally")

    def a_counts(block: Block) -> np.ndarray:
        return np.append(block.counts, texts)

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block(left.iloc[0], right, parts)
        seen = np.bincount(block.pair_of[block.train], minlength=len(block.pairs))
        c1 = a_counts(block)
        hot = block.hot(c1, total, parts)
        out = []
        for p, at in split_by(block.deal(c1, total, parts)):
            a = block.a[at]  # ascending, so that pairs of a first word are neighbours
            start = np.flatnonzero(np.diff(a, prepend=-1))
            runs = np.diff(np.append(start, len(a)))
            b = block.b[at]
            out.append((p, left["block"].iloc[0], pack(block.a_numbers[a[start]]), pack(hot[a[start]]), pack(runs), pack(block.numbers[b]), pack(block.counts[b]), pack(seen[at])))
        return pd.DataFrame(out, columns=["part", "block", "a", "hot", "runs", "b", "b_counts", "seen"])

    asked = blocks.groupBy("block").cogroup(given.groupBy("block")).applyInPandas(ask, "part int, block long, a binary, hot binary, runs binary, b binary, b_counts binary, seen binary")

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """Pair counts, and of each first word the mass of its seen words and how many of them were seen 1..K times."""
        firsts, runs = [unpack(x) for x in frame["a"]], [unpack(x).astype(np.int64) for x in frame["runs"]]
        a = np.repeat(np.concatenate(firsts), np.concatenate(runs))
        b = np.concatenate([unpack(x) for x in frame["b"]])
        names, a_at = np.unique(a, return_inverse=True)
        b_names, b_at = np.unique(b, return_inverse=True)
        pairs, place = np.unique(a_at * len(b_names) + b_at, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([unpack(x) for x in frame["seen"]]).astype(np.float64), minlength=len(pairs)).astype(np.int64)
        b_counts = np.zeros(len(b_names), dtype=np.int64)
        b_counts[b_at] = np.concatenate([unpack(x) for x in frame["b_counts"]]).astype(np.int64)
        pa_, pb = np.divmod(pairs, len(b_names))
        mass = np.bincount(pa_, weights=np.where(counts > 0, model(b_counts[pb]), 0), minlength=len(names))
        few = np.stack([np.bincount(pa_[counts == c], minlength=len(names)) for c in range(1, K + 1)], axis=1)
        is_hot = np.zeros(len(names), dtype=bool)
        is_hot[np.searchsorted(names, np.concatenate(firsts))] = np.concatenate([unpack(x) for x in frame["hot"]]).astype(bool)
        out, at = [], 0
        for block, f, r in zip(frame["block"], firsts, runs, strict=True):
            end = at + int(r.sum())
            own = np.searchsorted(names, f)
            own = own[~is_hot[own]]
            out.append((block, key[0], pack(counts[place[at:end]]), mass[own].tobytes() + b"|" + pack(few[own].ravel()) if len(own) else b"", None, None))
            at = end
        tally = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]
        out.append((-1, key[0], None, None, [0, *map(int, tally)], None))
        out += [(-2, key[0], None, None, [int(names[i]), *map(int, few[i])], float(mass[i])) for i in np.flatnonzero(is_hot)]
        return pd.DataFrame(out, columns=["block", "part", "first", "second", "tally", "mass"])

    pairs = materialise(asked.groupBy("part").applyInPandas(merge, ANSWER + ", mass double"))
    n2 = [int(x or 0) for x in pairs.filter("block = -1").select(*[F.sum(F.col("tally")[i]) for i in range(K + 2)]).first()]
    d = discounts(n2)
    # At most parts / HOT_SHARE first words are hot: the table's size follows from the number of parts.
    sums = pairs.filter("block = -2").groupBy(F.col("tally")[0].alias("a")).agg(F.sum("mass").alias("mass"), *[F.sum(F.col("tally")[c]).alias(f"few{c}") for c in range(1, K + 1)]).orderBy("a").collect()
    hot_names = np.array([r[0] for r in sums], dtype=np.uint64)
    hot_mass, hot_few = np.array([r[1] for r in sums]), np.array([r[2:] for r in sums], dtype=np.int64).reshape(-1, K)

    def evaluate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block(left.iloc[0], right[right["of_words"]], parts)
        c1 = a_counts(block)
        hot = block.hot(c1, total, parts)
        seen = np.zeros(len(block.pairs), dtype=np.int64)
        mass, few = np.zeros(len(c1)), np.zeros((len(c1), K), dtype=np.int64)
        rest = right[~right["of_words"]]
        by_part = {p: (x, y) for p, x, y in zip(rest["part"], rest["first"], rest["second"], strict=True)}
        for p, at in split_by(block.deal(c1, total, parts)):
            seen[at] = unpack(by_part[p][0])
            own = np.unique(block.a[at])
            own = own[~hot[own]]
            if len(own):
                data = by_part[p][1]
                mass[own] = np.frombuffer(data[: 8 * len(own)], dtype=np.float64)
                few[own] = unpack(data[8 * len(own) + 1 :]).reshape(-1, K)
        if hot.any() and len(hot_names):
            own = np.flatnonzero(hot)
            at = np.minimum(np.searchsorted(hot_names, block.a_numbers[own]), len(hot_names) - 1)
            here = hot_names[at] == block.a_numbers[own]
            mass[own[here]], few[own[here]] = hot_mass[at[here]], hot_few[at[here]]
        freed = few @ ((1 - d[1:]) * np.arange(1, K + 1))
        plain = (freed <= 0) & (c1 > 0)
        scale = c1 + plain
        left_over = np.where(plain, 1.0, freed) / np.maximum(1, scale)
        backoff = np.where(c1 > 0, left_over / np.maximum(1 - mass, 1e-300), 1.0)
        single = model(block.counts)
        kept = np.where(plain[block.a] | (seen > K), 1.0, d[np.minimum(seen, K)])
        with np.errstate(divide="ignore"):
            logs = np.log10(np.where(seen > 0, kept * seen / np.maximum(1, scale[block.a]), backoff[block.a] * single[block.b]))
        base = np.log10((block.counts + 1) / (total + distinct + 1))
        return pd.DataFrame(
            {
                "doc_id": pd.Series(block.doc_ids, dtype="object"),
                "held_out": block.held,
                "n_tokens": block.lengths,
                "n_known": np.add.reduceat(block.counts[block.tokens] > 0, block.first, dtype=np.int64),
                "train_tokens": total,
                "base_score": np.add.reduceat(base[block.tokens], block.first),
                "score": np.add.reduceat(logs[block.pair_of], block.first),
            }
        )

    back = given.withColumn("of_words", F.lit(True)).unionByName(pairs.filter("block >= 0").drop("tally", "mass").withColumn("of_words", F.lit(False)))
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_documents(df: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return score(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held.alias("held"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")))
