"""Gradient boosting for quantiles over a distributed table, and scoring with the trees as a broadcast table.

Each tree of depth 3 is fitted to the gradient of the quantile loss on binned features; its leaves are the quantiles of
the residuals (Friedman 2001). All rows are fitted, by tasks that each hold one part of them as bin numbers and run
together in one barrier stage (raw values go to a temporary file of the task). For each level of the trees of all
quantiles, a task counts its rows by node, feature, bin and side of the guess (once for all quantiles, by their
combinations); the first task adds the counts up, and all find the same split. The root's counts are kept from tree to tree,
and rows whose side has changed move in them; of two nodes with one parent only the smaller is counted, the other is what
remains of the parent. Leaf values come from counts of residuals, first in coarse ranges, then in fine ones within the range
that holds the quantile. What is exchanged are whole numbers and bounds, so the trees are the same however rows are dealt, and
its size depends on bins and leaves alone. Spark's own exchange between barrier tasks takes a second each time, so it passes
on only where the first task can be reached.

A lost task makes Spark run the stage again, from the same input and with the same result. A barrier stage needs as many
free cores as it has tasks, so a fit takes at most TASKS of them, and dynamic allocation has to be off (as Spark demands).
"""

from __future__ import annotations

import secrets
import socket
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, DEPTH, RATE = 64, 3, 0.05
ALPHAS = (0.1, 0.5, 0.9)
DEMAND_TREES, PRICE_TREES = 300, 400
NODES, LEAVES = 2**DEPTH - 1, 2**DEPTH
#: Ranges of residuals that are counted at once; two rounds tell values apart that differ by their spread / RANGES^2.
RANGES = 1024
#: Tasks of a fit, at most: the first receives what all others send, some 100 KB for each level.
TASKS = 64
#: Quantiles whose nodes and sides are counted in one go; at the last level 3 have 5^3 combinations.
JOINT = 3
#: The share of a slice's rows up to which they are picked out to be counted.
PICKED = 0.6
#: The share of values up to which those near the quantiles are picked out to be counted in finer ranges.
NEAR = 0.3
#: Rows that are worked on at once, in a fit and in scoring.
CHUNK, SCORED = 1 << 16, 1 << 14
MODEL = "alpha double, tree int, feature array<int>, threshold array<double>, value array<double>"
Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


class Peers:
    """The tasks of a fit. The first one adds up what the others send and answers them all; by default there is one task."""

    def __init__(self, links: list[socket.socket] | None = None, first: bool = True):
        self.links, self.first = links or [], first

    @classmethod
    def of(cls, context: BarrierTaskContext) -> Peers:
        """Connect the tasks of a barrier stage. The first one's address and a token go through the barrier."""
        rank, tasks = context.partitionId(), len(context.getTaskInfos())
        if tasks == 1:
            return cls()
        host, listener, token = context.getTaskInfos()[0].address.rsplit(":", 1)[0].strip("[]"), None, secrets.token_hex(16)
        if rank == 0:
            listener = socket.create_server((host, 0), backlog=tasks)
        port, token = context.allGather(f"{listener.getsockname()[1]} {token}" if listener else "")[0].split()
        links = []
        if listener is None:
            links.append(socket.create_connection((host, int(port))))
            links[0].sendall(token.encode())
        while listener is not None and len(links) < tasks - 1:
            link, _ = listener.accept()
            if secrets.compare_digest(_received(link, len(token)), token.encode()):
                links.append(link)
        if listener is not None:
            listener.close()
        for link in links:
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return cls(links, rank == 0)

    def total(self, counts: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of `counts` over the tasks, and the greatest of each of `bounds`."""
        sums, most = counts.astype(np.int64).ravel(), np.zeros(0) if bounds is None else bounds.astype(np.float64)
        size = 8 * (len(sums) + len(most))
        if not self.first:
            self.links[0].sendall(sums.tobytes() + most.tobytes())
            found = _received(self.links[0], size)
            sums, most = np.frombuffer(found, np.int64, len(sums)), np.frombuffer(found, np.float64, len(most), 8 * len(sums))
        else:
            for link in self.links:
                found = _received(link, size)
                sums = sums + np.frombuffer(found, np.int64, len(sums))
                most = np.maximum(most, np.frombuffer(found, np.float64, len(most), 8 * len(sums)))
            for link in self.links:
                link.sendall(sums.tobytes() + most.tobytes())
        return sums.reshape(counts.shape), most


def _received(link: socket.socket, size: int) -> bytes:
    out = bytearray(size)
    view, at = memoryview(out), 0
    while at < size:
        if not (n := link.recv_into(view[at:])):
            raise ConnectionError("another task of the fit has ended")
        at += n
    return bytes(out)


class Spool:
    """A column of numbers in a temporary file of its task: raw values are read in a few passes over slices, so they needn't
    be held."""

    def __init__(self) -> None:
        self.file, self.number = tempfile.TemporaryFile(), 0

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, dtype=np.float64).data)
        self.number += len(values)

    def __len__(self) -> int:
        return self.number

    def __getitem__(self, rows: slice) -> np.ndarray:
        start, stop, _ = rows.indices(self.number)
        self.file.seek(8 * start)
        return np.frombuffer(self.file.read(8 * (stop - start)), dtype=np.float64)


def _slices(n: int) -> list[slice]:
    return [slice(at, at + CHUNK) for at in range(0, n, CHUNK)]


@dataclass
class Part:
    """Values in groups 0 .. groups - 1, all of them between `low` and `high` (which hold for the values of all tasks)."""

    values: np.ndarray | Spool
    group: np.ndarray | int
    groups: int
    low: float
    high: float

    def placed(self, values: np.ndarray, group: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The key of each value's group and range, and its place on the scale of ranges."""
        x = values - self.low
        x *= self.scale
        kind = np.uint16 if self.groups * RANGES <= 1 << 16 else np.int64
        key = np.minimum(x.astype(kind), kind(RANGES - 1))
        if np.ndim(group):
            key += group.astype(kind) * kind(RANGES)
        elif group:
            key += kind(group * RANGES)
        return key, x

    @property
    def scale(self) -> float:
        return RANGES / (self.high - self.low) if self.high > self.low else 0.0

    def slices(self, ranges: slice | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | int]]:
        """Slice by slice the values and their group; with `ranges`, only those in or next to these."""
        near = None
        if ranges and self.scale:
            near = self.low + (ranges.start - 1) / self.scale, self.low + (ranges.stop + 1) / self.scale
        for rows in _slices(len(self.values)):
            values, group = self.values[rows], self.group if np.ndim(self.group) == 0 else self.group[rows]
            if near:
                close = np.flatnonzero((values >= near[0]) & (values <= near[1]))
                values, group = values[close], group if np.ndim(group) == 0 else group[close]
            yield values, group


def quantiles(peers: Peers, parts: list[Part], fractions: np.ndarray, exact: bool = False) -> np.ndarray:
    """Of each group of each part the values at `fractions` (groups, k) of its order, interpolated within a range of
    (high - low) / RANGES^2; with `exact`, one more round gives the value itself where a range holds a single one. NaN for
    empty groups."""
    groups, k = fractions.shape
    low, high = (np.repeat([getattr(p, side) for p in parts], [p.groups for p in parts]) for side in ("low", "high"))
    first = np.concatenate(([0], np.cumsum([p.groups for p in parts])))
    counts = np.zeros(groups * RANGES, dtype=np.int64)
    for p, at in zip(parts, first, strict=False):
        own = counts[at * RANGES : (at + p.groups) * RANGES]
        for values, group in p.slices():
            own += np.bincount(p.placed(values, group)[0], minlength=len(own))
    counted, _ = peers.total(counts.reshape(groups, RANGES))
    ends = counted.cumsum(axis=1)
    number = ends[:, -1:]
    rank = fractions * np.maximum(number - 1, 0)
    picked = np.minimum((ends[:, None, :] <= np.floor(rank)[:, :, None]).sum(axis=2), RANGES - 1)
    rest = rank - np.take_along_axis(ends - counted, picked, axis=1)
    # Ranges that hold a quantile are counted once more, in finer ones. Several quantiles of a group may share one.
    wanted, mine = np.unique(np.arange(groups)[:, None] * RANGES + picked, return_inverse=True)
    mine = mine.reshape(groups, k)
    slot = np.full(groups * RANGES, -1, dtype=np.int64)
    slot[wanted] = np.arange(len(wanted))

    def finer(p: Part, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Slice by slice the values in ranges that hold a quantile, and their finer range."""
        known = slot[at * RANGES : (at + p.groups) * RANGES]
        looked = known >= 0
        ranges = np.flatnonzero(looked) % RANGES
        ranges = slice(ranges.min(), ranges.max() + 1)
        few = counted[at : at + p.groups, ranges].sum() < NEAR * number[at : at + p.groups].sum()
        for values, group in p.slices(ranges if few else None):
            key, x = p.placed(values, group)
            held = np.flatnonzero(looked.take(key, mode="clip"))
            key = key[held]
            inside = x[held] - key % RANGES
            yield values[held], known[key] * RANGES + np.minimum((inside * RANGES).astype(np.int64), RANGES - 1)

    counts = np.zeros(len(wanted) * RANGES, dtype=np.int64)
    for p, at in zip(parts, first, strict=False):
        # The slots of a part lie side by side.
        begin, end = np.searchsorted(wanted, [at * RANGES, (at + p.groups) * RANGES]) * RANGES
        for _, key in finer(p, at):
            counts[begin:end] += np.bincount(key - begin, minlength=end - begin)
    counts, _ = peers.total(counts.reshape(len(wanted), RANGES))
    ends = counts.cumsum(axis=1)
    at = np.minimum((ends[mine] <= np.floor(rest)[:, :, None]).sum(axis=2), RANGES - 1)
    inside = rest - (ends[mine, at] - counts[mine, at])
    step = ((high - low) / RANGES**2)[:, None]
    out = low[:, None] + (picked * RANGES + at + (inside + 0.5) / (np.maximum(counts[mine, at], 1) + 0.5)) * step
    if exact:
        # The least and greatest value in each range that holds a quantile.
        order, name = np.unique(mine * RANGES + at, return_inverse=True)
        bounds = np.full((2, len(order)), -np.inf)
        for p, begin in zip(parts, first, strict=False):
            for values, key in finer(p, begin):
                place = np.searchsorted(order, key)
                among = np.flatnonzero(np.take(order, place, mode="clip") == key)
                np.maximum.at(bounds[0], place[among], -values[among])
                np.maximum.at(bounds[1], place[among], values[among])
        _, bounds = peers.total(np.zeros(0), bounds.ravel())
        least, most = (x[name.reshape(groups, k)] for x in (-bounds[: len(order)], bounds[len(order) :]))
        out = np.where(least == most, least, np.clip(out, least, most))
    return np.where(number > 0, out, np.nan)


def _splits(counts: np.ndarray, alpha: float, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node whether it splits, the feature and the last bin that goes left. `counts`: node, side of the guess (0:
    above), feature, bin. A row above the guess has gradient alpha, another one alpha - 1."""
    left = counts.cumsum(axis=3)
    n = left.sum(axis=1).astype(np.float64)
    s = alpha * n - left[:, 1]
    n_all, s_all = n[:, :, -1:], s[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / n + (s_all - s) ** 2 / (n_all - n) - s_all * s_all / n_all
    gain = np.where((n > 0) & (n < n_all) & usable, gain, -np.inf).reshape(len(counts), -1)
    at = gain.argmax(axis=1)
    return gain[np.arange(len(at)), at] > 1e-12, at // BINS, at % BINS


def _joined(kinds: np.ndarray, each: int) -> list[np.ndarray]:
    """For each JOINT quantiles one number that tells which of `each` kinds a row is in all of them."""
    out = []
    for at in range(0, len(kinds), JOINT):
        key = kinds[at].astype(np.uint16)
        for kind in kinds[at + 1 : at + JOINT]:
            key *= np.uint16(each)
            key += kind
        out.append(key)
    return out


def _counts(keys: list[np.ndarray], codes: np.ndarray, sums: list[np.ndarray], all_rows: bool = False) -> None:
    """Add the rows of a slice to `sums`: for each JOINT quantiles, by feature, by key and by bin. A row is counted once for
    all of these quantiles; _apart tells them apart. Rows with key 0 count for none of them, unless with `all_rows`, so few
    others are picked out."""
    for key, own in zip(keys, sums, strict=True):
        mine = codes
        if not all_rows:
            picked = np.flatnonzero(key != 0)
            if len(picked) < PICKED * len(key):
                key, mine = key[picked], codes.take(picked, axis=1, mode="clip")
        key = key * np.uint16(BINS)
        cell = np.empty_like(key)
        for j, code in enumerate(mine):
            own[j] += np.bincount(np.add(key, code, out=cell), minlength=own.shape[1])


def _moved(before: list[np.ndarray], after: list[np.ndarray], codes: np.ndarray, sums: list[np.ndarray]) -> None:
    """Move the rows of a slice whose key has changed in `sums`."""
    for old, new, own in zip(before, after, sums, strict=True):
        if len(picked := np.flatnonzero(old != new)):
            mine = codes.take(picked, axis=1, mode="clip") + np.arange(len(codes))[:, None] * own.shape[1]
            for key, sign in ((new, 1), (old, -1)):
                own += sign * np.bincount((mine + key[picked] * np.int64(BINS)).ravel(), minlength=own.size).reshape(own.shape)


def _apart(sums: list[np.ndarray], quantiles: int, each: int) -> np.ndarray:
    """The counts of each quantile by feature, kind and bin."""
    out = []
    for g, own in enumerate(sums):
        joint = min(JOINT, quantiles - g * JOINT)
        by = own.reshape(len(own), *[each] * joint, BINS)
        out += [by.sum(axis=tuple(1 + o for o in range(joint) if o != a)) for a in range(joint)]
    return np.stack(out)


def _bounds(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each row of `values` the least, negated, and the greatest, with those so far."""
    return np.maximum(bounds, np.stack((-values.min(axis=1), values.max(axis=1)), axis=1))


def _descend(state: np.ndarray, codes: np.ndarray, splits: list[list[tuple[int, int] | None]], level: int) -> None:
    """Move the rows of a slice to the children of their nodes; after the last level the state is the leaf alone. All nodes
    are asked of all rows, and the answer of a row's own node is picked by the way to it, a level at a time."""
    none = np.zeros(state.shape[1], dtype=bool)
    for own, asked in zip(state, splits, strict=True):
        right = [codes[s[0]] > s[1] if s else none for s in asked]
        for back in range(1, level + 1):
            way = (own & (1 << back)) != 0
            right = [x ^ ((x ^ y) & way) if x is not y else x for x, y in zip(right[::2], right[1::2], strict=True)]
        if level < DEPTH - 1:
            own += (own & 254) + (right[0].view(np.uint8) << 1)
        else:
            own &= 254
            own += right[0]


def _smaller(state: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Of each row of a slice 1 + twice the parent + the side where it is in the smaller child of its parent, otherwise 0."""
    out = np.empty_like(state)
    for own, kinds, child in zip(out, state, less, strict=True):
        # Twice the parent + the child, in each of these the side.
        place = kinds >> 1
        held = np.zeros(len(kinds), dtype=bool)
        for k, c in enumerate(child):
            held |= place == 2 * k + int(c)
        place &= 254
        place += kinds & 1
        place += 1
        np.multiply(place, held, out=own)
    return out


def grow(columns: list[np.ndarray] | list[Spool], y: np.ndarray | Spool, alphas: tuple[float, ...], trees: int, peers: Peers, rate: float = RATE) -> list[tuple[float, list[Tree]]]:
    """For each quantile the first guess, and of each tree its features, thresholds (go right above) and leaf values, already
    times `rate`. `columns` (the features) and `y` are this task's rows. What is held of a row are a byte for each feature,
    and for each quantile its residual and a byte for its node; all else is worked out slice by slice."""
    n, width, sizes = len(y), len(columns), _slices(len(y))
    most = np.full((2, width + 1), -np.inf)
    for rows in sizes:
        for j, column in enumerate([*columns, y]):
            values = column[rows]
            most[:, j] = np.maximum(most[:, j], (-values.min(), values.max()))
    count, most = peers.total(np.array([n]), most.ravel())
    if not count[0]:
        return []
    low, high = -most[: width + 1], most[width + 1 :]
    cuts = np.tile(np.arange(1, BINS) / BINS, (width, 1))
    edges = [np.unique(e) for e in quantiles(peers, [Part(c, 0, 1, low[j], high[j]) for j, c in enumerate(columns)], cuts, exact=True)]
    codes = np.empty((width, n), dtype=np.uint8)
    for rows in sizes:
        for j, e in enumerate(edges):
            codes[j, rows] = np.searchsorted(e, columns[j][rows], side="left")
    usable = np.arange(BINS)[None, :] < np.array([len(e) for e in edges])[:, None]
    starts = quantiles(peers, [Part(y, 0, 1, low[-1], high[-1])], np.array([alphas]), exact=True)[0]
    # A feature with one code never splits.
    counted = np.flatnonzero([len(e) > 1 or not any(len(o) > 1 for o in edges) for e in edges])
    if len(counted) < width:
        codes, edges, usable = codes[counted], [edges[j] for j in counted], usable[counted]
    joint = [min(JOINT, len(alphas) - at) for at in range(0, len(alphas), JOINT)]
    # The state of a row is its node, doubled, and 1 if it isn't above the guess; at the end of a tree it is the leaf alone.
    rest, state = np.empty((len(alphas), n)), np.empty((len(alphas), n), dtype=np.uint8)
    bounds, root = np.full((len(alphas), 2), -np.inf), [np.zeros((len(codes), 2**k * BINS), dtype=np.int64) for k in joint]
    for rows in sizes:
        np.subtract(y[rows], starts[:, None], out=rest[:, rows])
        bounds = _bounds(bounds, rest[:, rows])
        state[:, rows] = rest[:, rows] <= 0
        _counts(_joined(state[:, rows], 2), codes[:, rows], root, all_rows=True)
    found: list[tuple[float, list[Tree]]] = [(float(s), []) for s in starts]
    for t in range(trees):
        feature = np.zeros((len(alphas), NODES), dtype=np.int32)
        cut = np.full((len(alphas), NODES), BINS, dtype=np.int64)
        counts, most = peers.total(_apart(root, len(alphas), 2)[:, :, None], bounds.ravel())
        bounds = most.reshape(-1, 2)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            splits, less = [], np.zeros((len(alphas), wide), dtype=np.uint8)
            for a, alpha in enumerate(alphas):
                split, f, b = _splits(counts[a].transpose(1, 2, 0, 3), alpha, usable)
                split = np.flatnonzero(split)
                feature[a, first + split], cut[a, first + split] = f[split], b[split]
                # Python's numbers: numpy's would make bytes be compared as wide integers.
                splits.append([(int(f[k]), int(b[k])) if k in split else None for k in range(wide)])
                # The child with fewer rows; without a split that is the right one, which has none.
                for k in range(wide):
                    left = counts[a, f[k], k, :, : b[k] + 1].sum() if k in split else np.inf
                    less[a, k] = left > counts[a, f[k], k].sum() - left
            last = level == DEPTH - 1
            each = 2 * wide + 1
            sums = [] if last else [np.zeros((len(codes), each**k * BINS), dtype=np.int64) for k in joint]
            for rows in sizes:
                own = codes[:, rows]
                _descend(state[:, rows], own, splits, level)
                if not last:
                    _counts(_joined(_smaller(state[:, rows], less), each), own, sums)
            if not last:
                found_less, _ = peers.total(_apart(sums, len(alphas), each)[:, :, 1:])
                found_less = found_less.reshape(len(alphas), len(codes), wide, 2, BINS)
                others, right = counts - found_less, less[:, None, :, None, None] == 1
                counts = np.stack((np.where(right, others, found_less), np.where(right, found_less, others)), axis=3).reshape(len(alphas), len(codes), 2 * wide, 2, BINS)
        parts = [Part(rest[a], state[a], LEAVES, -bounds[a, 0], bounds[a, 1]) for a in range(len(alphas))]
        value = rate * np.nan_to_num(quantiles(peers, parts, np.repeat(alphas, LEAVES)[:, None])[:, 0]).reshape(len(alphas), LEAVES)
        bounds = np.full((len(alphas), 2), -np.inf)
        for rows in sizes if t < trees - 1 else []:
            held, before = rest[:, rows], _joined(rest[:, rows] <= 0, 2)
            for a in range(len(alphas)):
                held[a] -= value[a].take(state[a, rows], mode="clip")
            bounds = _bounds(bounds, held)
            state[:, rows] = held <= 0
            _moved(before, _joined(state[:, rows], 2), codes[:, rows], root)
        for a in range(len(alphas)):
            threshold = np.array([edges[f][c] if c < BINS else np.inf for f, c in zip(feature[a], cut[a], strict=True)])
            found[a][1].append((np.where(cut[a] < BINS, counted[feature[a]], 0).astype(np.int32), threshold, value[a]))
    return found


def fit_trees(x: np.ndarray, y: np.ndarray, alpha: float, trees: int, rate: float = RATE) -> tuple[float, list[Tree]]:
    """One quantile, with all rows in one place."""
    return grow(list(x.T), y, (alpha,), trees, Peers(), rate)[0]


def fit(rows: DataFrame, features: list[str], target: str, trees: int, key: tuple[str, ...] = ("product_id", "week"), alphas: tuple[float, ...] = ALPHAS, tasks: int | None = None) -> DataFrame:
    """Training rows to a table of trees (alpha, tree, feature, threshold, value); tree -1 holds the first guess. Rows with a
    null are left out; without rows the table is empty."""
    wanted = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"), F.xxhash64(*key).alias("h")).na.drop()
    tasks = tasks or min(rows.sparkSession.sparkContext.defaultParallelism, TASKS)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Spool() for _ in range(len(features) + 1)]
        for b in batches:
            for spool, c in zip(held, b.columns[:-1], strict=True):
                spool.append(c.to_numpy(zero_copy_only=False))
        peers = Peers.of(BarrierTaskContext.get())
        found = grow(held[:-1], held[-1], alphas, trees, peers)
        for link in peers.links:
            link.close()
        if peers.first:
            out = []
            for alpha, (start, grown) in zip(alphas, found, strict=False):
                out.append((alpha, -1, [], [], [start]))
                out += [(alpha, t, f.tolist(), th.tolist(), v.tolist()) for t, (f, th, v) in enumerate(grown)]
            kinds = [pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            names = ["alpha", "tree", "feature", "threshold", "value"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names)

    return wanted.repartition(tasks, "h").mapInArrow(train, MODEL, barrier=True)


class Ensemble:
    """All trees of one quantile as arrays."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["tree"])
        self.start = rows[0]["value"][0]
        self.feature = np.array([r["feature"] for r in rows[1:]], dtype=np.int64).reshape(-1, NODES)
        self.threshold = np.array([r["threshold"] for r in rows[1:]]).reshape(-1, NODES)
        self.value = np.array([r["value"] for r in rows[1:]]).reshape(-1, NODES + 1)

        # x > cuts[i] is the same as code > i, where the code is the number of cuts below x.
        self.cuts = {int(f): np.unique(self.threshold[self.feature == f]) for f in np.unique(self.feature)}
        self.kind = np.uint8 if max(map(len, self.cuts.values()), default=0) < 1 << 8 else np.uint32
        self.asked = [[(int(f), int(np.searchsorted(self.cuts[f], t))) for f, t in zip(*tree, strict=True)] for tree in zip(self.feature, self.threshold, strict=True)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A tree's seven questions are answered for a slice of rows at a time, by codes of a byte; the leaf follows from the
        answers' bits."""
        out = np.full(len(x), self.start)
        for a in range(0, len(x), SCORED):
            held = out[a : a + SCORED]
            codes = {f: np.searchsorted(cuts, np.ascontiguousarray(x[a : a + SCORED, f])).astype(self.kind) for f, cuts in self.cuts.items()}
            for asked, value in zip(self.asked, self.value, strict=True):
                q = [codes[f] > i for f, i in asked]
                second = q[1] ^ ((q[1] ^ q[2]) & q[0])
                left, right = q[3] ^ ((q[3] ^ q[4]) & second), q[5] ^ ((q[5] ^ q[6]) & second)
                leaf = q[0].view(np.uint8) << 1
                leaf += second.view(np.uint8)
                leaf <<= 1
                leaf += (left ^ ((left ^ right) & q[0])).view(np.uint8)
                held += value.take(leaf, mode="clip")
        return out


def ensembles(model: DataFrame) -> dict[float, Ensemble]:
    """The trees on the driver: their number is a parameter, not a matter of the data."""
    by_alpha: dict[float, list] = {}
    for r in model.collect():
        by_alpha.setdefault(r["alpha"], []).append(r)
    return {a: Ensemble(rows) for a, rows in by_alpha.items()}


def score(rows: DataFrame, features: list[str | Column], models: dict[float, Ensemble] | Broadcast, names: dict[float, str]) -> DataFrame:
    """Add a column for each quantile: max(0, prediction); null where a feature is null. `models` may be broadcast already."""
    shared = models if isinstance(models, Broadcast) else rows.sparkSession.sparkContext.broadcast({a: models[a] for a in names})
    order = list(names)

    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            x = np.stack([c.to_numpy(dtype=np.float64, na_value=np.nan) for c in columns], axis=1)
            bad = np.isnan(x).any(axis=1)
            got = {names[a]: np.maximum(0.0, shared.value[a].predict(np.where(bad[:, None], 0.0, x))) for a in order}
            yield pd.DataFrame({k: pd.Series(v).mask(bad) for k, v in got.items()})

    udf = F.pandas_udf(predict, ", ".join(f"{names[a]} double" for a in order), functionType=F.PandasUDFType.SCALAR_ITER)
    columns = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in features]
    return rows.withColumn("__q", udf(*columns)).select(*[c for c in rows.columns if c not in names.values()], "__q.*")
