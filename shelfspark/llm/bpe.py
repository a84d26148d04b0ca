"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token with which the encoding of that prefix can end. The table of
these last tokens is filled from left to right: a token that ends at position i is the last one if it is the whole prefix,
or if it may directly follow the last token of the shorter prefix. Walking back from the end of the table gives the
encoding. As an entry depends on earlier bytes alone, bytes can be appended without any recomputation, and after an edit
only the entries up to the point where old and new tables agree again are computed anew.

Whether token b may follow token a is a question of merge order: nothing that arises at the border while a and b are
being merged may join across it first (`Vocabulary.follows`).

Edge cases: a null text counts as empty; an empty text has no tokens and decodes to no bytes; null ids in a list to decode
are an error of the caller (ValueError); repeated rows are encoded each by itself; ids need not be unique.
"""

from __future__ import annotations

import base64
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import small_batches

#: A task keeps at most so many encoded chunks; the cache is emptied beyond, which changes no result.
CACHE_ENTRIES = 100_000
#: Pieces of up to so many bytes are encoded side by side; longer ones each by itself.
SIDE_BY_SIDE = 48
#: Places for pairs of tokens of which it is known whether they may follow each other.
PAIRS = 1 << 20
#: Texts are encoded together up to so many characters.
BATCH_CHARS = 1_000_000
NEVER = 1 << 62
#: ASCII white space next to a space.
BESIDE_SPACE = ["  ", *[x for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for x in (" " + c, c + " ")]]


class Table:
    """Integers of less than 2^62 to integers: open addressing in two arrays, read for many keys at once."""

    def __init__(self, held: dict[int, int]):
        keys, values = np.fromiter(held.keys(), dtype=np.int64, count=len(held)), np.fromiter(held.values(), dtype=np.int32, count=len(held))
        bits = max(4, (4 * len(held)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            at, first = np.unique(slot, return_index=True)
            free = first[self.keys[at] < 0]
            self.keys[slot[free]], self.values[slot[free]] = keys[left[free]], values[left[free]]
            stay = np.ones(len(left), dtype=bool)
            stay[free] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        away = np.flatnonzero((found != keys) & (found >= 0))
        while len(away):
            slot[away] = (slot[away] + 1) & self.mask
            found[away] = self.keys[slot[away]]
            away = away[(found[away] != keys[away]) & (found[away] >= 0)]
        return np.where(found == keys, self.values[slot], -1)


class Vocabulary:
    """Mergeable ranks as a table for prefix encoding."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Of each token the last two pieces that it is merged from.
        self.halves: dict[int, tuple[int, int]] = {}
        #: Tokens that merging doesn't make out of their own bytes; they stand only for a whole piece.
        self.unreachable = set()
        for data, rank in ranks.items():
            parts = self._merge(data, 2)
            if len(data) > 1:
                if len(parts) == 2 and ranks.get(parts[0] + parts[1]) == rank:
                    self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                else:
                    self.unreachable.add(rank)
        self.left_spine = {r: self._spine(r, 0) for r in self.bytes_of if r not in self.unreachable}
        self.right_spine = {r: self._spine(r, 1) for r in self.bytes_of if r not in self.unreachable}
        #: The tokens spelt backwards as a trie: node << 8 | byte -> node; at each node the token that ends there or -1.
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        for data, rank in ranks.items():
            if rank in self.unreachable:
                continue
            node = 0
            for byte in reversed(data):
                nxt = self.step.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.step[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = rank
        #: Whether token b may follow token a, by a << 32 | b.
        self.known: dict[int, bool] = {}

    def _merge(self, data: bytes, stop: int) -> list[bytes]:
        """Merge by lowest rank, leftmost first, down to `stop` parts."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                if (rank := self.ranks.get(parts[i] + parts[i + 1], NEVER)) < best:
                    best, at = rank, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, rank: int, side: int) -> list[int]:
        """The pieces that touch the token's left or right border while it is merged, from the byte to the token."""
        spine = [rank]
        while spine[-1] in self.halves:
            spine.append(self.halves[spine[-1]][side])
        return spine[::-1]

    def follows(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b are encoded as exactly [a, b]."""
        known = self.known.get(a << 32 | b)
        if known is not None:
            return known
        left, right, i, j = self.right_spine[a], self.left_spine[b], 0, 0
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else NEVER
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], NEVER)
            if across < grow_left and across <= grow_right and across < NEVER:
                fits = False
                break
            if grow_left == grow_right == NEVER:
                fits = True
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[a << 32 | b] = fits
        return fits

    def extend(self, data: bytes, last: list[int]) -> None:
        """Append the last tokens of the prefixes of `data` that are longer than `last`."""
        self.extend_to(data, last, len(data))

    def extend_to(self, data: bytes, last: list[int], stop: int) -> None:
        step, token_at, known, follows = self.step.get, self.token_at, self.known.get, self.follows
        for end in range(len(last), stop):
            node, at = 0, end
            while at >= 0:
                node = step(node << 8 | data[at])
                rank = token_at[node]
                if rank >= 0:
                    if not at:
                        break
                    before = last[at - 1]
                    fits = known(before << 32 | rank)
                    if fits or fits is None and follows(before, rank):
                        break
                at -= 1
            last.append(rank)

    def _arrays(self) -> None:
        """What `encode_pieces` reads, made when it is first used."""
        self.steps, self.ends = Table(self.step), np.array(self.token_at, dtype=np.int64)
        merges = {}
        for data, rank in self.ranks.items():
            for k in range(1, len(data)):
                a, b = self.ranks.get(data[:k]), self.ranks.get(data[k:])
                if a is not None and b is not None:
                    merges[a << 31 | b] = rank
        self.merges = Table(merges)
        top = max(self.bytes_of, default=-1) + 1
        self.length = np.zeros(top, dtype=np.int64)
        for rank, data in self.bytes_of.items():
            self.length[rank] = len(data)
        self.spines = []
        for side in (self.right_spine, self.left_spine):
            sizes = np.array([len(side.get(r, ())) for r in range(top)], dtype=np.int64)
            flat = np.fromiter((x for r in range(top) for x in side.get(r, ())), dtype=np.int64)
            self.spines.append((np.cumsum(sizes) - sizes, sizes, flat))
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)

    def _follow(self, pairs: np.ndarray) -> np.ndarray:
        """`follows` of many pairs a << 31 | b."""
        (start_a, size_a, left), (start_b, size_b, right) = self.spines
        a, b = pairs >> 31, pairs & (1 << 31) - 1
        i, j = start_a[a], start_b[b]
        end_i, end_j = i + size_a[a], j + size_b[b]
        fits, open_ = np.zeros(len(pairs), dtype=bool), np.arange(len(pairs))
        while len(open_):
            grow_left = np.where(i + 1 < end_i, left[np.minimum(i + 1, len(left) - 1)], NEVER)
            grow_right = np.where(j + 1 < end_j, right[np.minimum(j + 1, len(right) - 1)], NEVER)
            across = self.merges.get(left[i] << 31 | right[j]).astype(np.int64)
            across[across < 0] = NEVER
            crossed = (across < grow_left) & (across <= grow_right) & (across < NEVER)
            done = (grow_left == NEVER) & (grow_right == NEVER)
            fits[open_[done & ~crossed]] = True
            go, grow = ~(done | crossed), grow_left <= grow_right
            i, j = (i + grow)[go], (j + ~grow)[go]
            end_i, end_j, open_ = end_i[go], end_j[go], open_[go]
        return fits

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        pairs = before << 31 | token
        slot = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        out, unknown = self.pair_fits[slot], np.flatnonzero(self.pair_keys[slot] != pairs)
        if len(unknown):
            fresh, place = np.unique(pairs[unknown], return_inverse=True)
            out[unknown] = self._follow(fresh)[place]
            self.pair_keys[slot[unknown]], self.pair_fits[slot[unknown]] = pairs[unknown], out[unknown]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (32-bit integers) of short pieces that aren't tokens themselves: the tables of last tokens of all of
        them grow side by side, a byte in each step."""
        if not pieces:
            return []
        if not hasattr(self, "steps"):
            self._arrays()
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        start = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        last = np.zeros(len(data), dtype=np.int64)
        longest_first = np.argsort(-sizes, kind="stable")
        begin, ordered = start[longest_first], -sizes[longest_first]
        for end in range(int(sizes.max())):
            spot = begin[: np.searchsorted(ordered, -end)] + end
            node = np.zeros(len(spot), dtype=np.int64)
            for back in range(end + 1):
                node = self.steps.get(node << 8 | data[spot - back]).astype(np.int64)
                rank = self.ends[node]
                fits = rank >= 0
                if back < end:
                    some = np.flatnonzero(fits)
                    fits[some] = self._fits(last[spot[some] - back - 1], rank[some])
                last[spot[fits]] = rank[fits]
                spot, node = spot[~fits], node[~fits]
                if not len(spot):
                    break
        # Walk back from the ends; each round gives the next token from the right.
        at, own, found, owners = start + sizes - 1, np.arange(len(pieces)), [], []
        while len(own):
            token = last[at]
            found.append(token)
            owners.append(own)
            at = at - self.length[token]
            more = at >= start[own]
            at, own = at[more], own[more]
        owner = np.concatenate(owners[::-1])
        ids = np.concatenate(found[::-1])[np.argsort(owner, kind="stable")].astype(np.int32).tobytes()
        cuts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(pieces))))) * 4
        return list(map(ids.__getitem__, map(slice, cuts[:-1].tolist(), cuts[1:].tolist())))

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixEncoding(self, data).tokens()


class PrefixEncoding:
    """The encoding of one piece, which can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact append: earlier entries stay as they are."""
        self.data += data
        self.vocabulary.extend(self.data, self.last)

    def edit(self, start: int, end: int, data: bytes) -> int:
        """Replace data[start:end]; returns the number of entries computed anew. Once as many entries in a row as the
        longest token has bytes equal the old ones behind the edit, all later ones do."""
        old, old_tail = self.last, len(self.data) - end
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[:start]
        same = fresh = 0
        for stop in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend_to(self.data, self.last, stop)
            token = self.last[-1]
            fresh += 1
            before = len(old) - (len(self.data) - stop) - 1
            beyond = len(self.data) - stop < old_tail
            same = same + 1 if beyond and 0 <= before and old[before] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                break
        return fresh

    def tokens(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.data)
        if whole is not None:
            return [whole]
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[found[-1]])
        return found[::-1]


class TextEncoder:
    """Encodes whole texts: each match of the pattern separately.

    A single space between two characters that aren't white space always starts a match of the pattern, so what lies
    between such spaces (a chunk) is encoded by itself, and repeated chunks are encoded once.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        #: Chunks that have been encoded, and those that follow a single space, without it.
        self.chunks: dict[str, bytes] = {}
        self.after_space: dict[str, bytes] = {}
        self.rare = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        space = regex.compile(r"\s")
        self.blank = frozenset(c for c in map(chr, range(0x3100)) if space.match(c))

    def plain(self, text: str) -> bool:
        """Whether every space stands between two characters that aren't white space."""
        if text[0] == " " or text[-1] == " " or any(x in text for x in BESIDE_SPACE):
            return False
        return text.isascii() or not self.rare(text)

    def split(self, text: str) -> list[str]:
        parts, blank = text.split(" "), self.blank
        chunks, held, open_end = [], parts[0], not parts[0] or parts[0][-1] in blank
        for p in parts[1:]:
            if open_end or not p or p[0] in blank:
                held += " " + p
            else:
                chunks.append(held)
                held = " " + p
            open_end = not p or p[-1] in blank
        return [*chunks, held]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. A piece by itself is encoded as it is within the chunk."""
        pieces: dict[str, int] = {}
        number, of_chunk = pieces.setdefault, []
        for c in chunks:
            if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()):
                of_chunk.append((number(c, len(pieces)),))
            else:
                of_chunk.append([number(p, len(pieces)) for p in self.find(c)])
        out, batch, places, ranks = [], [], [], self.vocabulary.ranks
        for i, p in enumerate(pieces):
            data = p.encode("utf-8", "replace")
            whole = ranks.get(data)
            if whole is not None:
                out.append(whole.to_bytes(4, sys.byteorder))
            elif len(data) <= SIDE_BY_SIDE:
                out.append(b"")
                batch.append(data)
                places.append(i)
            else:
                out.append(np.array(self.vocabulary.encode_piece(data), dtype=np.int32).tobytes())
        for i, ids in zip(places, self.vocabulary.encode_pieces(batch), strict=True):
            out[i] = ids
        return [out[x[0]] if len(x) == 1 else b"".join([out[i] for i in x]) for x in of_chunk]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers. What the texts have in common is encoded once."""
        if len(self.chunks) + len(self.after_space) > CACHE_ENTRIES:
            self.chunks.clear()
            self.after_space.clear()
        parts, first, rest = [], set(), set()
        for t in texts:
            if not t:
                parts.append(((), ()))
                continue
            head, tail = ((one := t.split(" "))[:1], one[1:]) if self.plain(t) else (self.split(t), ())
            parts.append((head, tail))
            first.update(head)
            rest.update(tail)
        for cache, new, sign in ((self.chunks, list(first.difference(self.chunks)), ""), (self.after_space, list(rest.difference(self.after_space)), " ")):
            cache.update(zip(new, self._learn([sign + w for w in new] if sign else new), strict=True))
        get, after = self.chunks.__getitem__, self.after_space.__getitem__
        out = [b"".join(map(get, head)) + b"".join(map(after, tail)) for head, tail in parts]
        for cache, used in ((self.chunks, first), (self.after_space, rest)):
            for w in [w for w in used if len(w) > 64]:
                del cache[w]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Empty the caches: a worker that waits for other tasks keeps the vocabulary alone."""
        self.chunks.clear()
        self.after_space.clear()
        self.vocabulary.known.clear()


def decode(ids: list[int], bytes_of: list[bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, ids))


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A tiktoken file: on each line base64 of the token's bytes, and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in re.split(rb"\n", data) if line)}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def encoder(data: bytes, pattern: str) -> TextEncoder:
    """One encoder for each worker, kept between its tasks."""
    return TextEncoder(Vocabulary(parse_ranks(data)), pattern)


@lru_cache(maxsize=2)
def token_bytes(data: bytes) -> list[bytes]:
    """The bytes of each token, by its id; ids that the file doesn't have stand for none."""
    ranks = parse_ranks(data)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _of_about(batch: pa.RecordBatch, text_at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to `most` bytes of text; a longer text is a slice of its own."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()):
        if size + n > most and i > begin:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode_documents(df: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add `out` (array<int>), the ids of the whole text; other columns pass through. A column of that name is replaced.
    With a name for `decoded`, add the bytes (binary) to which the ids decode, made from the ids within the same task.

    Narrow: no shuffle. The driver reads the vocabulary file, whose size doesn't depend on the data, and broadcasts it.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))
    keep = [c for c in small_batches(df).columns if c not in (out, decoded)]
    arrow_out = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bytes_of = encoder(ranks.value, pattern), token_bytes(ranks.value) if decoded else []
        for whole in batches:
            for batch in _of_about(whole, len(keep), BATCH_CHARS):
                ids = coder.encode_all(batch.column(len(keep)).to_pylist())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                column = pa.ListArray.from_arrays(pa.array(offsets), values)
                texts = [pa.array([decode(np.frombuffer(x, dtype=np.int32).tolist(), bytes_of) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], column.cast(arrow_out), *texts], names=[*keep, out, *[decoded] * len(texts)])
        coder.forget()
        pa.default_memory_pool().release_unused()

    kept = [F.col(f"`{c}`") for c in keep]
    shape = _with(df.select(*kept), out, T.ArrayType(T.IntegerType()))
    return df.select(*kept, F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, shape.add(decoded, T.BinaryType()) if decoded else shape)


def decode_documents(df: DataFrame, vocabulary_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add `out` (binary), the bytes that the ids stand for; a null list decodes to no bytes. The ids pass through."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))
    keep = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = token_bytes(ranks.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = batch.column(batch.schema.get_field_index(ids))
                if lists.flatten().null_count:
                    raise ValueError("a list of token ids holds a null")
                cuts = np.cumsum([0, *[n or 0 for n in pc.list_value_length(lists).to_pylist()]])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                decoded = [decode(flat[a:b].tolist(), bytes_of) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(decoded, pa.binary())], names=[*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, _with(df.select(*[F.col(f"`{c}`") for c in keep]), out, T.BinaryType()))
