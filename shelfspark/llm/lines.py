"""Line dedup by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased, split at ASCII white space); lines of fewer than min_words words
are always kept; the query and the pipeline join all lines that have a word. A line goes if an earlier line of any
document, by (id, row, line number), has Jaccard similarity of at least 4/5 with it.

Lines with equal sets are merged first. The words of each distinct line are ordered by rarity over all lines: by the
counts of SPREAD hash values, whose table has a fixed size, then by hash. Two similar lines share a word among the first
|x| - ceil(4/5 |x|) + 1 of either; each line is posted under these. A word's postings are sorted by (size, position), so
that only classes of postings meet whose sizes are close enough and behind whose positions enough words are left to be
shared; pairs within them are tested by the parity of their hashed words (each differing word flips one bit). For each
line the first few candidates that pass are verified exactly; lines that match none of them though there were more are
then verified against all of theirs. Words are identified by 64-bit hashes. The postings of a word in more than HEAVY
lines are cut into slices, and each pair of slices is a task's work of its own.

Documents are ordinary rows of a table in buckets, next to a row of arrays for each block of them, so only postings,
candidates and answers are shuffled. A line's candidates end with its first match, so a large group of similar lines gives
a few pairs for each of them rather than all pairs.

Edge cases: null texts stay null, texts may become empty; ids are integers (others count as null), null ids come last;
repeated rows come in the order of their blocks; an empty table gives an empty table; other columns pass through
unchanged, and a column named removed_lines is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import bucketed, materialise, small_batches
from shelfspark.llm.packed import distinct, pack, ranked, split_by, spread, unpack

MIN_WORDS = 5
#: Least Jaccard similarity, as a fraction.
NUM, DEN = 4, 5
#: Candidates of a line within a word's postings in the first round.
FIRST_FEW = 2
BLOCK_BYTES = 12_000_000
#: Hash values whose counts give the order by rarity, and the pieces in which they are added up.
SPREAD_BITS, PIECES = 24, 64
#: Messages that are added up in one group.
ADDED = 2000
#: Postings of words in more lines than these are cut into slices of about so many.
HEAVY = 500_000
#: Pairs that are tested at once.
CHUNK = 1 << 20
#: Hash values of the filter for the second round.
SPOTS = 1 << 21
OTHER = np.uint64(0x5851F42D4C957F2D)

BLOCK = "block long, doc_row long, hashes binary, counts binary, tokens binary, sizes binary, set_a binary, set_b binary, set_key binary, set_at binary, parity binary, high binary, line_set binary, line_at binary"
ARRAYS = [c.split()[0] for c in BLOCK.split(", ")][2:]
MESSAGE = "block long, part int, first binary, second binary"
LONG = 96  # words from which on a line has 128 parity bits rather than 64


def _ceil(a: np.ndarray, b: int) -> np.ndarray:
    return -(-a // b)


def _tokenise(texts: pa.Array, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with enough words its text and its number within it, and how many words it has; of each word its local
    number; hashes of the distinct words."""
    lines = pc.split_pattern(pc.ascii_lower(texts), "\n")
    row = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    flat = pc.ascii_trim_whitespace(lines.flatten())
    full = pc.greater(pc.binary_length(flat), 0)
    words = pc.ascii_split_whitespace(flat.filter(full))
    at = np.flatnonzero(full.to_numpy(zero_copy_only=False))
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    if min_words > 1:
        enough = lengths >= min_words
        words, at, lengths = words.filter(pa.array(enough)), at[enough], lengths[enough]
    coded = words.flatten().dictionary_encode()
    names = coded.dictionary
    cuts = np.frombuffer(names.buffers()[1], dtype=np.int32)[names.offset : names.offset + len(names) + 1].tolist() if len(names) else [0]
    data = names.buffers()[2].to_pybytes() if len(names) else b""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(data.__getitem__, map(slice, cuts[:-1], cuts[1:]))), dtype=np.uint64, count=len(names))
    return row[at], number[at], lengths, coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64), hashes


def _in_blocks(batches: Iterator[pa.RecordBatch], text_at: int, block_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive rows with about so many bytes of text; a longer text is a block by itself."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        begin = 0
        for i, w in enumerate(pc.binary_length(whole.column(text_at)).fill_null(0).to_pylist()):
            size += w
            if size >= block_bytes:
                yield [*held, whole.slice(begin, i + 1 - begin)]
                begin, held, size = i + 1, [], 0
        if begin < whole.num_rows:
            held.append(whole.slice(begin))
    if held:
        yield held


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in 256 levels, eight for each doubling; 0 stands for one at most."""
    return np.minimum(255, np.rint(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def word_levels(blocks: DataFrame) -> Broadcast:
    """The level of each hash value's count in all lines."""
    bits = SPREAD_BITS - PIECES.bit_length() + 1

    def messages(spot: np.ndarray, count: np.ndarray, batch: int) -> pd.DataFrame:
        out = [(p, batch, pack(spot[at] & ((1 << bits) - 1)), pack(count[at])) for p, at in split_by(spot >> bits)]
        return pd.DataFrame(out, columns=["piece", "batch", "spots", "counts"])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                spots = (_u64(row.hashes) >> np.uint64(64 - SPREAD_BITS)).astype(np.int64)
                yield messages(spots, unpack(row.counts).astype(np.int64), row.block % 1_000_003)

    def summed(frame: pd.DataFrame) -> np.ndarray:
        held = np.zeros(1 << bits, dtype=np.int64)
        for s, c in zip(frame["spots"], frame["counts"], strict=True):
            np.add.at(held, unpack(s).astype(np.int64), unpack(c).astype(np.int64))
        return held

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = summed(frame)
        spot = np.flatnonzero(held)
        return messages(key[0] << bits | spot, held[spot], key[1])

    def close(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "levels": [pack(_levels(summed(frame)))]})

    sent = blocks.select("block", "hashes", "counts").mapInPandas(count, SENT)
    groups = blocks.count()
    while groups > ADDED:
        groups = -(-groups // ADDED)
        sent = sent.withColumn("batch", F.col("batch") % groups).groupBy("piece", "batch").applyInPandas(add, SENT)
    rows = {r["piece"]: unpack(r["levels"]).astype(np.uint8) for r in sent.groupBy("piece").applyInPandas(close, "piece int, levels binary").collect()}
    none = np.zeros(1 << bits, dtype=np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(np.concatenate([rows.get(p, none) for p in range(PIECES)]))


SENT = "piece int, batch long, spots binary, counts binary"


def build_blocks(docs: DataFrame, id_at: int, text_at: int, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with their block and row in it, and for each block a row of arrays: the distinct lines as sets of local
    word numbers, and where each line is. The words of a line are hashed to parity bits: `parity` has 64 of them, and
    `high`, of long lines alone, the upper half if they were 128."""

    def arrays(ids: pa.Array, texts: pa.Array) -> list[bytes]:
        doc_keys = ids.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
        row, n, lengths, flat, hashes = _tokenise(texts, min_words)
        counts = np.bincount(flat.astype(np.int64), minlength=len(hashes))
        key, at = doc_keys[row], row.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
        pairs = distinct(np.repeat(np.arange(len(lengths), dtype=np.uint64) << np.uint64(32), lengths) | flat)
        line, token = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.diff(line, prepend=-1))
        sizes = np.diff(np.append(start, len(line)))
        fold = lambda how, x: how.reduceat(x[token], start) if len(start) else np.zeros(0, dtype=np.uint64)
        mixed = spread(hashes)
        set_a, set_b = fold(np.add, mixed), fold(np.add, spread(hashes ^ OTHER))
        bits = np.uint64(1) << (mixed & np.uint64(63))
        parity, high = fold(np.bitwise_xor, bits), fold(np.bitwise_xor, np.where(mixed & np.uint64(64), bits, np.uint64(0)))
        # Equal sets become one; the first line stands for them.
        order = np.lexsort((at, key, set_b, set_a))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(set_a[order]) != 0) | (np.diff(set_b[order]) != 0)
        line_set = np.empty(len(order), dtype=np.int64)
        line_set[order] = np.cumsum(fresh) - 1
        first = order[fresh]
        tokens = token[_ranges(start[first], sizes[first])]
        return [hashes.tobytes(), pack(counts), pack(tokens), pack(sizes[first]), *[x[first].tobytes() for x in (set_a, set_b, key, at, parity)], pack(np.where(sizes >= LONG, high, np.uint64(0))[first]), pack(line_set), at.tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, held in enumerate(_in_blocks(batches, text_at, block_bytes)):
            begin, block = 0, task << 32 | number
            for x in held:
                none = [pa.nulls(x.num_rows, pa.binary())] * len(ARRAYS)
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(np.full(x.num_rows, block)), pa.array(np.arange(begin, begin + x.num_rows)), *none], names=names)
                begin += x.num_rows
            table = pa.Table.from_batches(held)
            made = arrays(table.column(id_at).combine_chunks(), table.column(text_at).combine_chunks())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, f.type) for f in held[0].schema], pa.array([block]), pa.nulls(1, pa.int64()), *[pa.array([v], pa.binary()) for v in made]], names=names)
        pa.default_memory_pool().release_unused()

    names = [*docs.columns, "block", "doc_row", *ARRAYS]
    shape = docs.limit(0).join(docs.sparkSession.createDataFrame([], BLOCK)).schema
    return bucketed(docs.mapInArrow(run, shape), "block")


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


READY = "block long, is_first binary, line binary, position binary, word binary, level binary"


def prepare(blocks: DataFrame, parts: int, levels: Broadcast) -> DataFrame:
    """Of each block, which of its lines are the first of all with their sets, and these lines' postings: the words of each
    line come in the order of their levels, then hashes, which is the same in all blocks, and its prefix is posted, without
    words that one line alone has."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                a, b, key, at_ = map(_u64, (row.set_a, row.set_b, row.set_key, row.set_at))
                out = [(row.block, p, np.concatenate((a[at], b[at])).tobytes(), pack(np.concatenate((key[at], at_[at])))) for p, at in split_by((a % np.uint64(parts)).astype(np.int64))]
                yield pd.DataFrame(out, columns=["block", "part", "first", "second"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        halves = [_u64(x).reshape(2, -1) for x in frame["first"]]
        lengths = [h.shape[1] for h in halves]
        (a, b), (key_, at) = np.concatenate(halves, axis=1), np.concatenate([unpack(x).reshape(2, -1) for x in frame["second"]], axis=1)
        order = np.lexsort((at, np.repeat(frame["block"].to_numpy(), lengths), key_, b, a))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        first = np.zeros(len(order), dtype=bool)
        first[order[fresh]] = True
        out = [(bl, key[0], pack(f), None) for bl, f in zip(frame["block"], np.split(first, np.cumsum(lengths)[:-1]), strict=True)]
        return pd.DataFrame(out, columns=["block", "part", "first", "second"])

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by_part = dict(zip(right["part"], right["first"], strict=True))
        row = left.iloc[0]
        a, hashes, sizes = _u64(row["set_a"]), _u64(row["hashes"]), unpack(row["sizes"]).astype(np.int64)
        first = np.zeros(len(a), dtype=bool)
        for p, at in split_by((a % np.uint64(parts)).astype(np.int64)):
            first[at] = unpack(by_part[p]).astype(bool)
        own, start = np.flatnonzero(first), np.cumsum(sizes) - sizes
        tokens = unpack(row["tokens"]).astype(np.int64)[_ranges(start[own], sizes[own])]
        level = levels.value[(hashes >> np.uint64(64 - SPREAD_BITS)).astype(np.int64)]
        order = np.lexsort((hashes, level))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        line = np.repeat(own, sizes[own])
        tokens = order[np.sort(line << 32 | rank[tokens]) & 0xFFFFFFFF]
        position = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
        at = np.flatnonzero((position < (sizes - _ceil(sizes * NUM, DEN) + 1)[line]) & (level[tokens] > 0))
        return pd.DataFrame([[int(row["block"]), pack(first), pack(line[at]), pack(position[at]), pack(tokens[at]), pack(level[tokens[at]])]], columns=[c.split()[0] for c in READY.split(", ")])

    answers = blocks.select("block", "set_a", "set_b", "set_key", "set_at").mapInPandas(ask, MESSAGE).groupBy("part").applyInPandas(merge, MESSAGE)
    return bucketed(blocks.select("block", "hashes", "tokens", "sizes", "set_a").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(join, READY), "block")


class Postings:
    """The postings of a block's lines."""

    def __init__(self, row):
        self.block, self.numbers, self.sizes = int(row.block), _u64(row.hashes), unpack(row.sizes).astype(np.int64)
        self.line, self.position, self.word = (unpack(x).astype(np.int64) for x in (row.line, row.position, row.word))
        self.count = np.exp2(unpack(row.level) / 8).astype(np.int64)
        self.row = row

    def spots(self, at: np.ndarray) -> np.ndarray:
        """Hash values of the words of these postings, for the filter of the second round."""
        return (spread(self.numbers[self.word[at]] ^ OTHER) % np.uint64(SPOTS)).astype(np.int64)

    def packed(self, at: np.ndarray, active: np.ndarray, parts: int, heavy: int) -> pd.DataFrame:
        """These postings by part. Those of a heavy word go to the cells of their slice: the pairs that it makes with each
        slice, itself included. In a cell of two slices only pairs across them count (`side`)."""
        key, place, parity, high = _u64(self.row.set_key), _u64(self.row.set_at), _u64(self.row.parity), unpack(self.row.high)
        number, line, position, count = self.numbers[self.word[at]], self.line[at], self.position[at], self.count[at]
        side = np.zeros(len(at), dtype=np.int64)
        if (count > heavy).any():
            slices = np.where(count > heavy, _ceil(count, heavy), 1)
            again = np.repeat(np.arange(len(at)), slices)
            other = np.arange(len(again)) - np.repeat(np.cumsum(slices) - slices, slices)
            own = (spread(key[line] ^ spread(place[line])) % slices.astype(np.uint64)).astype(np.int64)[again]
            number, line, position = number[again], line[again], position[again]
            cell = np.minimum(own, other) * slices[again] + np.maximum(own, other)
            number = np.where(slices[again] > 1, spread(number ^ spread(cell.astype(np.uint64))), number)
            side = np.where(own == other, 0, np.where(own < other, 1, 2))
        out = []
        for p, own in split_by((spread(number) % np.uint64(parts)).astype(np.int64)):
            n = line[own]
            # Words of a part are told apart by 32 bits: others that agree give more candidates, not other results.
            held = [spread(number[own]) >> np.uint64(32), n, position[own], self.sizes[n], key[n], place[n], active[n], side[own]]
            out.append((p, self.block, *map(pack, held), parity[n].tobytes(), pack(high[n])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in POSTED.split(", ")])


POSTED = "part int, block long, token binary, line binary, position binary, size binary, key binary, at binary, active binary, side binary, parity binary, high binary"


def _chunks(weights: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose weights add up to about `most`."""
    ends, begin = np.cumsum(weights), 0
    while begin < len(weights):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right")))
        yield slice(begin, end)
        begin = end


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def candidates(token: np.ndarray, side: np.ndarray, size: np.ndarray, position: np.ndarray, parity: np.ndarray, high: np.ndarray, active: np.ndarray, few: int | None, tested: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in the order of their lines to pairs (later, earlier) that pass the filters, and which of the later ones
    have got `few` pairs before all that fit were seen. The number of pairs tested is added to `tested`."""
    n = len(token)
    got, more = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    found_y, found_x = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if not n:
        return found_y[0], found_x[0], more
    kind = size << 32 | side << 30 | position
    order = np.lexsort((kind, token))  # stable: within a class in the order of the lines
    word, kind = token[order], kind[order]
    new_word = np.concatenate(([True], word[1:] != word[:-1]))
    fresh = new_word | np.concatenate(([True], kind[1:] != kind[:-1]))
    start = np.flatnonzero(fresh)
    length = np.diff(np.append(start, n))
    place = (np.cumsum(fresh) - 1) << 32 | order
    # Of each class: word, size, side, words from the position on; the greatest size that these words allow a partner.
    of_word, c_size, c_side = np.cumsum(new_word)[start] << 32, kind[start] >> 32, kind[start] >> 30 & 3
    rest = c_size - (kind[start] & (1 << 30) - 1)
    most = np.minimum(DEN * c_size // NUM, (NUM + DEN) * rest // NUM - c_size)
    begin, end = np.searchsorted(of_word | c_size, of_word | _ceil(NUM * c_size, DEN)), np.searchsorted(of_word | c_size, of_word | np.maximum(most, 0), side="right")
    own = np.flatnonzero(end - begin > (length == 1) & (begin == np.arange(len(start))))
    begin, width = begin[own], (end - begin)[own]
    for some in _chunks(width, CHUNK):
        a, b = np.repeat(own[some], width[some]), _ranges(begin[some], width[some])
        met = (rest[b] >= _ceil(NUM * (c_size[a] + c_size[b]), NUM + DEN)) & ((c_side[a] == 0) | (c_side[a] != c_side[b])) & ((a != b) | (length[a] > 1))
        a, b = a[met], b[met]
        for part in _chunks(length[a], CHUNK):
            y, of = order[_ranges(start[a[part]], length[a[part]])], np.repeat(b[part], length[a[part]])
            of, y = of[active[y]], y[active[y]]
            earlier = np.searchsorted(place, of << 32 | y) - start[of]
            of, y, earlier = of[earlier > 0], y[earlier > 0], earlier[earlier > 0]
            done, step = np.zeros(len(y), dtype=np.int64), 4
            while len(y):
                if few is not None:
                    full = got[y] >= few
                    more[y[full]] = True
                    y, of, earlier, done = y[~full], of[~full], earlier[~full], done[~full]
                for these in _chunks(np.minimum(earlier - done, step), 4 * CHUNK):
                    take = np.minimum(earlier[these] - done[these], step)
                    late, early = np.repeat(y[these], take), order[_ranges(start[of[these]] + done[these], take)]
                    both = size[late] + size[early]
                    low, up = parity[late] ^ parity[early], np.where(np.minimum(size[late], size[early]) >= LONG, high[late] ^ high[early], np.uint64(0))
                    fits = np.bitwise_count(low ^ up).astype(np.int64) + np.bitwise_count(up) <= both - 2 * _ceil(NUM * both, NUM + DEN)
                    found_y.append(late[fits])
                    found_x.append(early[fits])
                    np.add.at(got, late[fits], 1)
                    if tested is not None:
                        tested.append(len(late))
                done += step
                y, of, earlier, done = y[done < earlier], of[done < earlier], earlier[done < earlier], done[done < earlier]
                step = min(2 * step, 1024)
    return np.concatenate(found_y), np.concatenate(found_x), more


def _met(ready: DataFrame, open_: DataFrame) -> Broadcast:
    """Which of SPOTS hash values the posted words of the open lines have: a filter of fixed size for all postings."""

    slices = 64

    def mark(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"slice": [], "bits": []})
        lines = Postings(left.iloc[0])
        held = np.zeros(SPOTS, dtype=bool)
        held[lines.spots(np.flatnonzero(np.isin(lines.line, right["line"].to_numpy())))] = True
        return pd.DataFrame({"slice": range(slices), "bits": [pack(x) for x in np.packbits(held).reshape(slices, -1)]})

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([unpack(x).astype(np.uint8) for x in frame["bits"]])
        return pd.DataFrame({"slice": [key[0]], "bits": [bits.tobytes()]})

    marks = ready.groupBy("block").cogroup(open_.groupBy("block")).applyInPandas(mark, "slice int, bits binary")
    parts = {r["slice"]: r["bits"] for r in marks.groupBy("slice").applyInPandas(merge, "slice int, bits binary").collect()}
    held = b"".join(bytes(parts[k]) for k in range(slices))
    return ready.sparkSession.sparkContext.broadcast(np.unpackbits(np.frombuffer(held, dtype=np.uint8)).astype(bool))


def _find(ready: DataFrame, parts: int, heavy: int, open_: DataFrame | None = None) -> DataFrame:
    """Candidate pairs: later line (y_block, y), earlier line (x_block, x), and whether y may have more. In the first round
    the earliest FIRST_FEW of each line; with open lines, all of theirs."""
    if open_ is None:

        def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    lines = Postings(row)
                    yield lines.packed(np.arange(len(lines.line)), np.ones(len(lines.sizes), dtype=np.int64), parts, heavy)

        posted = ready.mapInPandas(post, POSTED)
    else:
        met = _met(ready, open_)

        def post_open(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            lines = Postings(left.iloc[0])
            active = np.zeros(len(lines.sizes), dtype=np.int64)
            active[right["line"].to_numpy()] = 1
            return lines.packed(np.flatnonzero(met.value[lines.spots(np.arange(len(lines.line)))]), active, parts, heavy)

        posted = ready.groupBy("block").cogroup(open_.groupBy("block")).applyInPandas(post_open, POSTED)
    few = FIRST_FEW if open_ is None else None

    def pair(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        token, line, position, size, key_, at, active, side = (np.concatenate([unpack(x) for x in frame[c]]) for c in ("token", "line", "position", "size", "key", "at", "active", "side"))
        high = np.concatenate([unpack(x) for x in frame["high"]])
        parity = np.concatenate([_u64(x) for x in frame["parity"]])
        block = np.repeat(frame["block"].to_numpy(), [len(x) // 8 for x in frame["parity"]])
        by_token = np.argsort(token)
        same = token[by_token][1:] == token[by_token][:-1]
        shared = by_token[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        order = shared[np.lexsort((at[shared], block[shared], key_[shared]))]
        ordered = lambda x: x[order].astype(np.int64)
        y, x, more = candidates(token[order], ordered(side), ordered(size), ordered(position), parity[order], high[order], active[order].astype(bool), few)
        y_, x_ = order[y], order[x]
        x_key = (key_[x_] ^ np.uint64(1 << 63)).view(np.int64)
        return pd.DataFrame({"y_block": block[y_], "y": line[y_].astype(np.int64), "x_key": x_key, "x_block": block[x_], "x_at": at[x_].astype(np.int64), "x": line[x_].astype(np.int64), "more": more[y]})

    pairs = posted.groupBy("part").applyInPandas(pair, "y_block long, y long, x_key long, x_block long, x_at long, x long, more boolean")
    once = pairs.groupBy("y_block", "y", "x_key", "x_block", "x_at", "x").agg(F.max("more").alias("more"))
    if few is not None:
        w = Window.partitionBy("y_block", "y")
        once = once.withColumns({"n": F.row_number().over(w.orderBy("x_key", "x_block", "x_at")), "more": F.max("more").over(w) | (F.count("*").over(w) > few)}).filter(F.col("n") <= few)
    return materialise(once.select("y_block", "y", "x_block", "x", "more"))


def _words(row: pd.Series, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of these lines of a block: sizes, local word numbers; and the hashes of all words of the block."""
    sizes = unpack(row["sizes"]).astype(np.int64)
    start = np.cumsum(sizes) - sizes
    return sizes[lines], unpack(row["tokens"])[_ranges(start[lines], sizes[lines])].astype(np.int64), _u64(row["hashes"])


def _verify(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines (block, line) of which a candidate has the similarity. The later line's block sends its words to the earlier
    line's block, once for each such block."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(right):
            block = int(left["block"].iloc[0])
            asking, place_of = ranked(right["y"].to_numpy())
            all_sizes, tokens, hashes = _words(left.iloc[0], asking)
            start, x = np.cumsum(all_sizes) - all_sizes, right["x"].to_numpy()
            for x_block, at in split_by(ranked(right["x_block"].to_numpy())[1]):
                once, place = ranked(place_of[at])
                held = [np.array([len(once)]), asking[once], all_sizes[once], x[at], place]
                out.append((int(right["x_block"].iloc[at[0]]), block, pack(np.concatenate(held)), hashes[tokens[_ranges(start[once], all_sizes[once])]].tobytes()))
        return pd.DataFrame(out, columns=["block", "y_block", "asked", "words"])

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right):
            return pd.DataFrame({"block": [], "line": []})
        messages = [unpack(x).astype(np.int64) for x in right["asked"]]
        asked, _ = ranked(np.concatenate([m[2 * m[0] + 1 :].reshape(2, -1)[0] for m in messages]))
        x_sizes, tokens, hashes = _words(left.iloc[0], asked)
        by_hash = np.argsort(hashes)
        sorted_hashes = hashes[by_hash]
        held = np.sort(np.repeat(np.arange(len(asked)), x_sizes) * len(hashes) + tokens)
        blocks_, found = [], []
        for y_block, message, words in zip(right["y_block"], messages, right["words"], strict=True):
            n = int(message[0])
            y, y_sizes = message[1 : n + 1], message[n + 1 : 2 * n + 1]
            x, place = message[2 * n + 1 :].reshape(2, -1)
            x, sizes = np.searchsorted(asked, x), y_sizes[place]
            own = _u64(words)[_ranges((np.cumsum(y_sizes) - y_sizes)[place], sizes)]
            at = np.minimum(np.searchsorted(sorted_hashes, own), len(sorted_hashes) - 1)
            known = sorted_hashes[at] == own
            keys = np.repeat(x, sizes) * len(hashes) + by_hash[at]
            where = np.minimum(np.searchsorted(held, keys), len(held) - 1)
            shared = np.add.reduceat((known & (held[where] == keys)).astype(np.int64), np.cumsum(sizes) - sizes)
            hit = (NUM + DEN) * shared >= NUM * (sizes + x_sizes[x])
            found.append(distinct(y[place[hit]]))
            blocks_.append(np.full(len(found[-1]), y_block))
        return pd.DataFrame({"block": np.concatenate(blocks_), "line": np.concatenate(found)})

    words = blocks.select("block", "hashes", "tokens", "sizes")
    to_y = pairs.select(F.col("y_block").alias("block"), "y", "x_block", "x")
    sent = words.groupBy("block").cogroup(to_y.groupBy("block")).applyInPandas(send, "block long, y_block long, asked binary, words binary")
    return materialise(words.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(check, "block long, line long").distinct())


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS, heavy: int = HEAVY) -> DataFrame:
    """`df` with `text` without the removed lines, and removed_lines (long); a column of that name is replaced."""
    own = [c for c in small_batches(df).columns if c != "removed_lines"]
    kinds = [df.schema[c].dataType for c in own]
    docs = df.select(*[F.col(f"`{c}`").cast("string" if c == text else k).alias(f"c{i}") for i, (c, k) in enumerate(zip(own, kinds, strict=True))], F.col(f"`{doc_id}`").try_cast("long").alias("id"))
    text_name = f"c{own.index(text)}"
    table = build_blocks(docs, len(own), own.index(text), block_bytes, min_words)
    blocks = table.filter("hashes is not null").select("block", *ARRAYS)
    parts = max(64, blocks.count())
    levels = word_levels(blocks)
    marked = prepare(blocks, parts, levels)
    ready = blocks.select("block", "hashes", "sizes", "set_key", "set_at", "parity", "high").join(marked, "block")
    pairs = _find(ready, parts, heavy)
    found = _verify(blocks, pairs)
    open_ = pairs.filter("more").select(F.col("y_block").alias("block"), F.col("y").alias("line")).distinct()
    open_ = materialise(open_.join(found, ["block", "line"], "left_anti"))
    if not open_.isEmpty():
        found = found.unionByName(_verify(blocks, _find(ready, parts, heavy, open_)))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        held = left.filter(pc.is_null(left.column("doc_row"))).select(["set_at", "line_set", "line_at"]).to_pylist()[0]
        stays = unpack(next(x for x in right.column("first").to_pylist() if x is not None)).astype(bool)
        stays[np.array([x for x in right.column("line").to_pylist() if x is not None], dtype=np.int64)] = False
        line_set, line_at, set_at = unpack(held["line_set"]).astype(np.int64), _u64(held["line_at"]), _u64(held["set_at"])
        gone = np.sort(line_at[~(stays[line_set] & (line_at == set_at[line_set]))])
        row, number = (gone >> np.uint64(32)).astype(np.int64), (gone & np.uint64(0xFFFFFFFF)).tolist()
        docs = left.filter(pc.is_valid(left.column("doc_row")))
        rows = docs.column("doc_row").to_numpy()
        begin, end = np.searchsorted(row, rows), np.searchsorted(row, rows, side="right")
        texts = docs.column(text_name).to_pylist()
        for i in np.flatnonzero(end > begin).tolist():
            out = set(number[begin[i] : end[i]])
            texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n")) if n not in out)
        docs = docs.set_column(docs.column_names.index(text_name), text_name, pa.array(texts, pa.string()))
        return docs.select(range(len(own))).append_column("removed_lines", pa.array(end - begin, pa.int64()))

    told = marked.select(F.col("block").alias("block"), F.col("is_first").alias("first"), F.lit(None).cast("long").alias("line")).unionByName(found.select("block", F.lit(None).cast("binary").alias("first"), "line"))
    shape = table.select(*table.columns[: len(own)]).withColumn("removed_lines", F.lit(0).cast("long")).schema
    whole = table.select(*table.columns[: len(own)], "block", "doc_row", "set_at", "line_set", "line_at")
    return whole.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, shape).toDF(*own, "removed_lines")
