"""Symbol strings added up in sorted ranges.

A map task adds up what it has, sorts it and cuts it at the bounds of the ranges; each cut is one
compressed run, which takes a third of the bytes of its rows in a shuffle. Partition i then merges
the runs of range i, so partitions are in order and no key is in two of them. The bounds come from
a bounded sample and decide the balance only. A key that is frequent is one row of each run.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.symbols import END

PACK_ROWS, PACK_BYTES = 2_000_000, 128 << 20  # what a map task holds before it writes runs
RANGE_ROWS = 1_000_000  # rows of a range, before those of one key are added up
LEAST_ROWS = 20_000  # a range isn't made smaller than this to have one for each core
SAMPLE_LINES, SAMPLE_ROWS = 4096, 200_000
OUT_ROWS = 20_000  # rows of a batch that goes back
FOLDED = "p string, n long, below boolean, done boolean"
_ZSTD = pa.Codec("zstd", compression_level=6)
_RUN = "range int, rows int, size long, run binary"


def bounds(sample: DataFrame, fraction: float, m: int | None = None) -> list[str]:
    """Bounds of ranges of about RANGE_ROWS rows from a sample (p) of that fraction of all, of m rows."""
    m = sample.count() if m is None else m
    few = sample.select("p").sample(min(1.0, SAMPLE_ROWS / max(m, 1)), 7) if m > SAMPLE_ROWS else sample.select("p")
    got = sorted(r.p for r in few.collect())
    total, cores = m / fraction, sample.sparkSession.sparkContext.defaultParallelism
    n = int(max(total / RANGE_ROWS, min(cores, total / LEAST_ROWS))) + 1
    return sorted({got[i * len(got) // n] for i in range(1, n)}) if got else []


def add_up(p, n):
    """Distinct p in order, and the sums of n."""
    total = pc.sum(pc.abs(pc.cast(n, pa.float64(), safe=False))).as_py() or 0.0
    if total >= 2**62:
        sums: dict = {}
        for x, c in zip(p.to_pylist(), n.to_pylist()):
            sums[x] = sums.get(x, 0) + c
        if any(not -(2**63) <= c < 2**63 for c in sums.values()):
            raise OverflowError("a count beyond the range of longs")
        p, n = pa.array(sums.keys(), pa.large_string()), pa.array(sums.values(), pa.int64())
    p, n = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (p, n))
    if len(p) and pc.all(pc.less(p[:-1], p[1:])).as_py():  # as a file of a saved index has them
        return p, n
    g = pa.table([p, n], names=["p", "n"]).group_by("p", use_threads=False).aggregate([("n", "sum")])
    p, n = (pa.concat_arrays(g[c].chunks) if g[c].num_chunks != 1 else g[c].chunk(0) for c in ("p", "n_sum"))
    order = pc.sort_indices(p)
    return p.take(order), n.take(order)


def raw(p) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large string array; the offsets start at 0."""
    offsets = np.frombuffer(p.buffers()[1], np.int64)[p.offset : p.offset + len(p) + 1]
    data = np.frombuffer(p.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


class _View:
    def __init__(self, p):
        self.p = p

    def __len__(self):
        return len(self.p)

    def __getitem__(self, i):
        return self.p[i].as_py()


def _pack(batches, cuts: list[str]):
    held: list = []

    def flush():
        t = pa.Table.from_batches(held)
        held.clear()
        p, n = add_up(t.column(0).cast(pa.large_string()), t.column(1))
        at = [0, *(bisect_left(_View(p), c) for c in cuts), len(p)]
        rows = []
        for i in range(len(at) - 1):
            if at[i] < at[i + 1]:
                part = slice(at[i], at[i + 1])
                offsets, data = raw(p[part])
                plain = b"".join((n[part].to_numpy().astype("<i8").tobytes(), np.diff(offsets).astype("<u4").tobytes(), data.tobytes()))
                rows.append((i, at[i + 1] - at[i], len(plain), _ZSTD.compress(plain, asbytes=True)))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["range", "rows", "size", "run"])

    rows = size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= PACK_ROWS or size >= PACK_BYTES:
            yield flush()
            rows = size = 0
    if held:
        yield flush()


def _unpack(rows: int, size: int, run: bytes):
    plain = _ZSTD.decompress(run, size)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.frombuffer(plain, "<u4", rows, 8 * rows), out=offsets[1:])
    p = pa.Array.from_buffers(pa.large_string(), rows, [None, pa.py_buffer(offsets), plain.slice(12 * rows)])
    return p, pa.array(np.frombuffer(plain, "<i8", rows))


def _merge(batches, finish, last: int):
    """finish(p, n, first, last) of each range: its distinct strings in order, with their sums."""
    held: dict[int, list] = {}
    rows: dict[int, int] = {}

    def summed(i):
        parts = held.pop(i)
        return add_up(pa.chunked_array([x for x, _ in parts]), pa.chunked_array([x for _, x in parts]))

    for b in batches:
        for i, k, size, run in zip(*(c.to_pylist() for c in b.columns)):
            held.setdefault(i, []).append(_unpack(k, size, run))
            rows[i] = rows.get(i, 0) + k
            if rows[i] > 4 * RANGE_ROWS and len(held[i]) > 1:
                held[i] = [summed(i)]
                rows[i] = 0
    for i in sorted(held):
        yield from finish(*summed(i), i == 0, i == last)


def ordered(rows: DataFrame, finish, ddl: str, sample: tuple | None = None) -> DataFrame:
    """What finish yields of the sums of rows(p, n), a partition for each range, in order.

    sample: rows of a fraction of the input, and that fraction, where rows itself are dear.
    """
    if sample is None:
        total = rows.count()
        f = min(1.0, SAMPLE_ROWS / max(total, 1))
        sample = (rows.sample(f, 7) if f < 1 else rows, f, int(total * f))
    cuts = bounds(*sample)
    last = len(cuts)
    packed = rows.mapInArrow(lambda it: _pack(it, cuts), _RUN)
    return packed.repartitionById(last + 1, "range").mapInArrow(lambda it: _merge(it, finish, last), ddl)


def texts(offsets: np.ndarray, data: np.ndarray, row: np.ndarray, length: np.ndarray):
    """A string array of the first `length` bytes of each `row`."""
    ends = np.zeros(len(row) + 1, np.int32)
    np.cumsum(length, out=ends[1:])
    at = np.arange(ends[-1], dtype=np.int64) + np.repeat(offsets[row] - ends[:-1], length)
    return pa.Array.from_buffers(pa.string(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data[at])])


def plain(cut: int):
    """finish: the strings without their last `cut` bytes, and their sums."""

    def finish(p, n, first, last):
        offsets, data = raw(p)
        length = np.diff(offsets) - cut
        for a in range(0, len(p), OUT_ROWS):
            row = np.arange(a, min(a + OUT_ROWS, len(p)))
            yield pa.RecordBatch.from_arrays([texts(offsets, data, row, length[row]), n[a : a + OUT_ROWS]], names=["chain", "cnt"])

    return finish


def shared_bytes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the row before, at its start."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros(n, np.int64)
    live, at = np.arange(1, n), 0
    while len(live):  # 16 bytes further each turn, rows that differ drop out
        most = np.minimum(size[live], size[live - 1])
        col = at + np.arange(16)
        inside = col[None, :] < most[:, None]
        a = np.minimum(offsets[live][:, None] + col, len(data) - 1)
        b = np.minimum(offsets[live - 1][:, None] + col, len(data) - 1)
        same = inside & (data[a] == data[b])
        run = np.where(same.all(1), 16, same.argmin(1))
        out[live] += run
        live, at = live[run == 16], at + 16
    return out


def fold(least: int | None):
    """finish: counts of the boundary prefixes of sorted strings, as rows of FOLDED in order.

    least None: every prefix has all counts below it. Otherwise one with fewer adds its count to
    the prefix before. What may go on in a neighbouring range (prefixes of this one's first or
    last row) isn't done, unless there is no neighbour.
    """

    def finish(p, n, first, last):
        offsets, data = raw(p)
        n = n.to_numpy().astype(np.int64)
        mark = data == 0x20
        tail = np.zeros(len(data), bool)
        if len(data) > 3:  # PB and END
            tail[3:] = (data[:-3] == 0xF4) & (data[1:-2] == 0x8F) & (data[2:-1] == 0xBF) & (data[3:] >= 0xBE)
        ends = np.flatnonzero(mark | tail) + 1
        row = np.searchsorted(offsets, ends, "left") - 1
        length = ends - offsets[row]
        begin = np.searchsorted(row, np.arange(len(p)))
        depth = np.arange(len(row)) - begin[row]
        new = length > shared_bytes(offsets, data)[row]
        order = np.argsort(depth, kind="stable")  # by depth, then row: rows of one prefix are neighbours
        starts = np.flatnonzero(new[order])
        node = order[starts]  # a prefix, by the first row that has it
        of = np.cumsum(new[order]) - 1
        done = np.ones(len(node), bool)
        if not first:
            done[row[node] == 0] = False
        if not last:
            done[of[row[order] == len(p) - 1]] = False
        if least is None:
            count, low, keep = np.add.reduceat(n[row[order]], starts), np.zeros(len(node), bool), np.ones(len(node), bool)
        else:
            count, low, keep = np.zeros(len(node), np.int64), np.zeros(len(node), bool), np.zeros(len(node), bool)
            carry, below = n.copy(), np.zeros(len(p), bool)
            levels = np.searchsorted(depth[order], np.arange(depth.max() + 2))
            for d in range(len(levels) - 2, -1, -1):
                a, b = levels[d], levels[d + 1]
                i, j = np.searchsorted(starts, [a, b])
                rows, at, own = row[order[a:b]], starts[i:j] - a, done[i:j]
                total, under = np.add.reduceat(carry[rows], at), np.logical_or.reduceat(below[rows], at)
                emit = own & ((total >= least) | ((total > 0) & under))
                carry[rows], below[rows] = 0, False
                carry[rows[at]] = np.where(own & ~emit, total, 0)
                below[rows[at]] = own & (emit | under)
                count[i:j], low[i:j], keep[i:j] = total, under, emit | (~own & ((total != 0) | under))
        back = np.argsort(node, kind="stable")  # in the order of the strings
        back = back[keep[back]]
        node, count, low, done = node[back], count[back], low[back], done[back]
        for a in range(0, len(node), OUT_ROWS):
            x = slice(a, a + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([texts(offsets, data, row[node[x]], length[node[x]]), pa.array(count[x]), pa.array(low[x]), pa.array(done[x])], names=["p", "n", "below", "done"])

    return finish


def marked(counts: DataFrame, *more) -> DataFrame:
    """(p, n) of (chain, cnt): the chains with their end mark, and more columns."""
    return counts.select(*more, F.concat("chain", F.lit(END)).alias("p"), F.coalesce(F.col("cnt").cast("long"), F.lit(0).cast("long")).alias("n"))


def chains(counts: DataFrame, sample: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(chain, cnt): the sums over equal chains, in the order of the chains with their end mark."""
    found = sample and (marked(sample[0]), sample[1])
    return ordered(marked(counts), plain(len(END.encode())), "chain string, cnt long", found)


def folded(counts: DataFrame, least: int | None, sample: tuple[DataFrame, float] | None = None) -> DataFrame:
    """fold() over all chains (chain, cnt) but empty ones."""
    found = sample and (marked(sample[0].where("chain <> ''")), sample[1])
    return ordered(marked(counts.where("chain <> ''")), fold(least), FOLDED, found)


def _stretches(batches, finish):
    """finish(p, n, False, False) of rows (stretch, p, n): of each stretch, in parts of about RANGE_ROWS rows."""
    held: list = []
    at, rows = None, 0

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        yield from finish(t.column("p").chunk(0).cast(pa.large_string()), t.column("n").chunk(0), False, False)

    for b in batches:
        ids = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and (ids[i] != at or rows >= RANGE_ROWS):
                yield from done()
                rows = 0
            held.append(b.slice(i, j - i))
            at, rows = ids[i], rows + j - i
    if held:
        yield from done()


def folded_in_order(counts: DataFrame, least: int | None) -> DataFrame:
    """fold() over the chains of files which each have a range of their own in order, without a shuffle.

    Files come in any order and in parts, so the prefixes at the edges of each part aren't done.
    """
    stretch = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("stretch")
    return marked(counts.where("chain <> ''"), stretch).mapInArrow(lambda it: _stretches(it, fold(least)), FOLDED)
