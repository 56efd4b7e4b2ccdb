"""Suffix-array dedup: bytes covered by a long string that also starts anywhere else.

A sparse suffix array decides which strings of SPAN bytes repeat. Every window of SPAN bytes
has one anchor, fixed by its content: the leftmost least hash among the first SPAN - GRAM + 1
GRAM-byte strings in it; so equal windows have equal anchors at equal places, and only the
suffixes at anchors need sorting. The steps:

1. Equal texts are grouped by digest (first text, number of copies): all windows of a text
   with copies repeat.
2. Anchors whose GRAM bytes occur once, by a 64-bit hash, can't repeat and are dropped.
3. Each task sorts its anchors' suffixes, merges equal contexts, and sends front-coded runs
   (shared prefix length and remaining bytes) to the partition of their first GRAM bytes.
4. A partition merges its runs with a loser tree that keeps each candidate's common prefix
   with the last output and compares bytes only from there on.
5. With the common prefixes of neighbours in suffix order, and of neighbours in the order of
   the reversed bytes before the anchors, a window repeats if another anchor falls in the same
   class in both; all anchors of a partition are done together for each distance.

Null texts count as empty: no bytes, nothing removed, and the digest of no bytes. Texts below
SPAN bytes lose nothing. Matches never cross texts. Repeated rows count as other documents, so
both lose all; extra columns are ignored by `remove_repeats` and kept by `cut_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.base import free_name, give_back, pieces, slices, small_batches, stage, stage_bucketed, text_bytes

SPAN, GRAM = 200, 64
REACH = SPAN - GRAM + 1  # places of a window's anchor
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_KEY = 16  # bytes of a text's digest that name it


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit rolling hash of the `gram` bytes at each position that has as many."""
    n = len(raw)
    if n < gram:
        return np.zeros(0, np.uint64)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers)])
    inverse = np.full(n - gram + 1, pow(_BASE, -1, 2**64), np.uint64)
    inverse[0] = 1
    h = (sums[gram:] - sums[:-gram]) * np.cumprod(inverse)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, hash, least, most) of the anchors of the texts that end at `ends` in raw.

    An anchor at p serves the windows that start at p - most .. p - least.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(raw)
    n = len(raw) - SPAN + 1
    if n <= 0:
        return none
    place = np.arange(len(h), dtype=np.uint64)
    code = (h & ~np.uint64(0xFFFFFF)) | place  # below 2**24 bytes at a time; ties go to the left
    blocks = -(-len(code) // REACH)
    padded = np.full(blocks * REACH, np.uint64(2**64 - 1))
    padded[: len(code)] = code
    grid = padded.reshape(blocks, REACH)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    limit = np.repeat(ends, ends - starts)[:n]
    window = np.flatnonzero(np.arange(n) + SPAN <= limit)
    if not len(window):
        return none
    at = at[window]
    text = np.searchsorted(ends, window, "right")
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    p = at[new]
    return p, h[p], p - window[np.r_[new[1:], len(at)] - 1], p - window[new]


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each ends."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws], dtype=np.int64)


def text_anchors(raw: np.ndarray, ends: np.ndarray, most: int = 1 << 24) -> tuple[np.ndarray, ...]:
    """anchors(), in slices where a single text is longer than the place code allows."""
    step = most - SPAN
    if len(raw) <= step:
        return anchors(raw, ends)
    found = []
    for a in range(0, len(raw) - SPAN + 1, step):
        piece = raw[a : a + step + SPAN - 1]
        p, h, lo, hi = anchors(piece, np.array([len(piece)]))
        found.append((p + a, h, lo, hi))
    return tuple(np.concatenate(x) for x in zip(*found))


# --- front-coded runs


def front_code(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(shared prefix with the row before, the remaining bytes of all rows) of a sorted byte matrix."""
    n, width = rows.shape
    shared = np.zeros(n, np.int64)
    if n > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), width)
    shared = np.minimum(shared, np.minimum(sizes, np.r_[0, sizes[:-1]]))
    column = np.arange(width)
    return shared, rows[(column >= shared[:, None]) & (column < sizes[:, None])].tobytes()


def front_decode(shared: np.ndarray, sizes: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for s, n in zip(shared.tolist(), sizes.tolist()):
        last = last[:s] + rest[at : at + n - s]
        at += n - s
        out.append(last)
    return out


def common(a: bytes, b: bytes, start: int) -> int:
    """The common prefix length of a and b, known to be at least `start`."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n  # the first difference is in [lo, hi)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class LoserTree:
    """Merges sorted runs of (keys, shared prefixes), never comparing a known common prefix again."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = [r for r in runs]
        self.k = len(runs)
        self.at = [0] * self.k
        self.key: list[bytes | None] = [r[0][0] if r[0] else None for r in runs]
        self.known = [0] * self.k  # common prefix of each candidate with the last output
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _beats(self, i: int, j: int) -> bool:
        """Whether candidate i comes first; then the loser's prefix refers to the winner."""
        a, b = self.key[i], self.key[j]
        if a is None or b is None:
            return b is None
        ci, cj = self.known[i], self.known[j]
        if ci != cj:
            return ci > cj  # both follow the last output: the longer shared prefix is smaller
        c = common(a, b, ci)
        first = a[c:] <= b[c:]
        self.known[j if first else i] = c
        return first

    def _enter(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        """(run, index in the run, common prefix with the row before) in sorted order."""
        if not self.k:
            return
        while self.key[w := self.tree[0]] is not None:
            keys, shared = self.runs[w]
            i = self.at[w]
            yield w, i, self.known[w]
            self.at[w] = i = i + 1
            if i < len(keys):
                self.key[w], self.known[w] = keys[i], shared[i]
            else:
                self.key[w] = None
            node = (w + self.k) // 2
            while node:
                other = self.tree[node]
                if self._beats(other, w):
                    self.tree[node], w = w, other
                node //= 2
            self.tree[0] = w


# --- the stages


def _anchor_blobs(batches, buckets: int):
    """(bucket, blob) rows: the anchors' hashes with the text's key and position."""
    for b in batches:
        for part in slices(b, 1):
            keys, (raw, ends) = part.column(0).to_pylist(), joined(part.column(1).to_pylist())
            p, h, _, _ = text_anchors(raw, ends)
            if not len(p):
                continue
            text = np.searchsorted(ends, p, "right")
            place = p - np.r_[0, ends][text]
            to = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                at = order[cuts[k] : cuts[k + 1]]
                if len(at):
                    used, index = np.unique(text[at], return_inverse=True)
                    rows.append((k, h[at].tobytes(), index.astype("<u4").tobytes(), place[at].astype("<u4").tobytes(), b"".join(keys[t] for t in used)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "h", "t", "p", "keys"])
    give_back()


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """(dk, p) of the anchors whose hash occurs more than once in the bucket."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    many = np.zeros(len(h), bool)
    many[order] = np.r_[False, same] | np.r_[same, False]
    out, at = [], 0
    for t, p, keys in zip(pdf["t"], pdf["p"], pdf["keys"]):
        t, p = np.frombuffer(t, "<u4"), np.frombuffer(p, "<u4")
        m = many[at : at + len(t)]
        at += len(t)
        t, p = t[m], p[m]
        if not len(t):
            continue
        order = np.argsort(t, kind="stable")
        t, p = t[order], p[order]
        cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        for a, e in zip(cut, np.r_[cut[1:], len(t)]):
            out.append((keys[_KEY * t[a] : _KEY * (t[a] + 1)], p[a:e].astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["dk", "p"])


def _run_blobs(batches, buckets: int):
    """Front-coded runs of the marked anchors' contexts, a row for each bucket; and spans found on the way.

    Contexts that a batch has several times repeat for certain: their spans are returned at once
    (bucket -1) and one of them goes on without a return address.
    """
    for b in batches:
        for part in slices(b, 1):
            keys, (raw, ends), marks = part.column(0).to_pylist(), joined(part.column(1).to_pylist()), part.column(2).to_pylist()
            p, h, least, most = text_anchors(raw, ends)
            text = np.searchsorted(ends, p, "right")
            starts = np.r_[0, ends]
            wanted = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(m, "<u4").astype(np.int64) + starts[i] for i, m in enumerate(marks))])
            keep = np.isin(p, wanted)
            p, h, least, most, text = (x[keep] for x in (p, h, least, most, text))
            for a in range(0, len(p), 20_000):
                yield from _runs(raw, starts, keys, *(x[a : a + 20_000] for x in (p, h, least, most, text)), buckets)
    give_back()


def _runs(raw, starts, keys, p, h, least, most, text, buckets):
    n = len(p)
    right = np.zeros((n, SPAN), np.uint8)
    left = np.zeros((n, REACH - 1), np.uint8)
    size = SPAN - least
    for j in range(SPAN):
        m = j < size
        right[m, j] = raw[p[m] + j]
    for j in range(REACH - 1):
        m = j < most
        left[m, j] = raw[p[m] - 1 - j]
    bounds = np.stack([size, most], 1).astype(">u2").view(np.uint8)
    whole = np.ascontiguousarray(np.concatenate([right, bounds, left], 1))  # rows that are equal have equal contexts
    order = np.argsort(whole.view(f"S{whole.shape[1]}").ravel(), kind="stable")
    # a zero byte at the end of a short suffix sorts like its end; the sizes behind it keep rows apart
    p, h, least, most, text, size, right, left, whole = (x[order] for x in (p, h, least, most, text, size, right, left, whole))
    new = np.r_[True, (whole[1:] != whole[:-1]).any(1)]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    spans = []
    if several.any():
        t, at = text[several], p[several] - starts[text[several]]
        spans = _span_rows(t, at - most[several], at - least[several] + SPAN, keys)
    place = p - starts[text]
    to = (h % np.uint64(buckets)).astype(np.int64)
    rows = []
    for k in np.unique(to[new]):
        at = np.flatnonzero(new & (to == k))
        shared, rest = front_code(right[at], size[at])
        used, index = np.unique(text[at], return_inverse=True)
        lefts = left[at][np.arange(REACH - 1) < most[at][:, None]].tobytes()
        head = np.stack([shared, size[at], most[at], index, place[at], several[at]]).astype("<u4").tobytes()
        rows.append((int(k), head, rest, lefts, b"".join(keys[t] for t in used)))
    names = ["bucket", "head", "rest", "lefts", "keys", "spans"]
    empty = [None] * len(spans)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows] + [-1] * len(spans), pa.int32()),
            *(pa.array([r[i] for r in rows] + empty, pa.binary()) for i in (1, 2, 3)),
            pa.array([r[4] for r in rows] + [s[0] for s in spans], pa.binary()),
            pa.array([None] * len(rows) + [s[1] for s in spans], pa.binary()),
        ],
        names=names,
    )


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """(dk, spans): byte spans of texts that repeated windows of this bucket cover."""
    heads = [np.frombuffer(x, "<u4").reshape(6, -1).astype(np.int64) for x in pdf["head"]]
    runs = [(front_decode(h[0], h[1], rest), h[0].tolist()) for h, rest in zip(heads, pdf["rest"])]
    order = [(w, i, c) for w, i, c in LoserTree(runs)]
    run, index, shared = (np.array(x, np.int64) for x in zip(*order))
    base = np.r_[0, np.cumsum([h.shape[1] for h in heads])]
    flat = base[run] + index
    _, size, most, text, place, several = (x[flat] for x in np.concatenate(heads, axis=1))
    least = SPAN - size
    n = len(size)
    left = np.zeros((base[-1], REACH - 1), np.uint8)
    left[np.arange(REACH - 1) < np.concatenate([h[2] for h in heads])[:, None]] = np.frombuffer(b"".join(pdf["lefts"]), np.uint8)
    left = left[flat]
    group = np.cumsum(shared < GRAM)
    coded = np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), left], 1)
    by_left = np.argsort(np.ascontiguousarray(coded).view(f"S{coded.shape[1]}").ravel(), kind="stable")
    rows = coded[by_left]
    differ = rows[1:] != rows[:-1]
    before = np.r_[-5, np.where(differ.any(1), differ.argmax(1), coded.shape[1])] - 4  # below 0: another group
    repeats = np.zeros((n, REACH), bool)
    for o in range(REACH):
        active = np.flatnonzero((least <= o) & (most >= o))
        if not len(active):
            continue
        right_class = np.cumsum(shared < SPAN - o)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.cumsum(before < o)
        code = right_class[active] * (n + 1) + left_class[active]
        sort = np.argsort(code, kind="stable")
        s = code[sort]
        same = s[1:] == s[:-1]
        repeats[active[sort], o] = np.r_[False, same] | np.r_[same, False]
    repeats[several > 0] = False  # these have been returned
    edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    names = list(pdf["keys"])
    owner, inverse = np.unique(np.stack([run[row], text[row]]), axis=1, return_inverse=True)
    keys = [names[r][_KEY * t : _KEY * (t + 1)] for r, t in owner.T.tolist()]
    return pd.DataFrame(_span_rows(inverse.ravel(), place[row] - (high - 1), place[row] - low + SPAN, keys), columns=["dk", "spans"])


def _span_rows(owner: np.ndarray, a: np.ndarray, e: np.ndarray, keys: list[bytes]) -> list[tuple[bytes, bytes]]:
    """(key, packed starts and ends) of each owner's spans, overlaps joined."""
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])[: len(owner)]
    rows = []
    for x, y in zip(cuts, np.r_[cuts[1:], len(owner)]):
        at = order[x:y]
        rows.append((keys[owner[at[0]]], np.stack(_union(a[at], e[at]), 1).astype("<u4").tobytes()))
    return rows


def _union(a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the spans' union."""
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.r_[True, a[1:] > e[:-1]])
    return a[new], e[np.r_[new[1:] - 1, len(e) - 1]]


def _cut(raw: bytes, copies: int, spans) -> tuple[bytes, int]:
    """(remaining bytes, removed runs)."""
    if copies > 1 and len(raw) >= SPAN:
        return b"", 1
    if not spans:
        return raw, 0
    a, e = _union(*np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2).T.astype(np.int64))
    return b"".join(raw[x:y] for x, y in zip(np.r_[0, e].tolist(), np.r_[a, len(raw)].tolist())), len(a)


def _text_key(text):
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, _KEY)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(dk, text, copies): each text once; one shuffle of the texts, combined on the map side.

    Written in buckets of dk, so that the joins by dk that follow read the texts in place.
    """
    slim = docs.select(_text_key(F.col("text")).alias("dk"), F.coalesce("text", F.lit("")).alias("text"))
    return stage_bucketed(slim.groupBy("dk").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", "dk")


def repeated_spans(texts: DataFrame, size: int) -> DataFrame:
    """(dk, spans): packed spans of the texts that repeat; together they cover every byte to remove."""
    n = pieces(size, 64 << 20)
    blobs = texts.mapInArrow(lambda it: _anchor_blobs(it, n), "bucket int, h binary, t binary, p binary, keys binary")
    repeated = blobs.groupBy("bucket").applyInPandas(lambda pdf: _repeated(pdf), "dk binary, p binary")
    marks = repeated.groupBy("dk").agg(F.array_join(F.collect_list(F.hex("p")), "").alias("p")).select("dk", F.unhex("p").alias("p"))
    marked = texts.join(marks.hint("shuffle_hash"), "dk").select("dk", "text", "p")
    m = pieces(size, 16 << 20)
    runs = stage(marked.mapInArrow(lambda it: _run_blobs(it, m), "bucket int, head binary, rest binary, lefts binary, keys binary, spans binary"), "runs")
    early = runs.where("bucket < 0").select(F.col("keys").alias("dk"), "spans")
    merged = runs.where("bucket >= 0").groupBy("bucket").applyInPandas(lambda pdf: _merge(pdf), "dk binary, spans binary")
    return early.unionAll(merged)


def _kept(docs: DataFrame, make_rows, ddl: str) -> DataFrame:
    """(dk, columns of ddl) of each distinct text; make_rows(raw, remaining, runs) gives a row."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    _, size = text_bytes(docs)
    texts = distinct_texts(docs)
    spans = repeated_spans(texts, size).groupBy("dk").agg(F.collect_list("spans").alias("spans"))
    types = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(ddl)]
    names = T.StructType.fromDDL(ddl).names

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            rows = []
            for text, copies, found in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                raw = text.encode("utf-8", "surrogatepass")
                rows.append(make_rows(raw, *_cut(raw, copies, found)))
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["dk", *names])

    return texts.join(spans.hint("shuffle_hash"), "dk", "left").mapInArrow(run, f"dk binary, {ddl}")


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs."""
    row = lambda raw, kept, runs: (len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    kept = _kept(docs, row, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    dk = free_name(docs.select(key), "dk")
    return docs.select(key, _text_key(F.col("text")).alias(dk)).join(kept.withColumnRenamed("dk", dk), dk).drop(dk)


def cut_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with the repeated bytes cut out of text and n_chars set anew; broken characters at a cut go too."""
    row = lambda raw, kept, runs: (kept.decode("utf-8", "ignore") if runs else None, runs)
    dk, kept, runs = (free_name(docs, x) for x in ("dk", "kept", "runs"))
    cut = _kept(docs, row, "kept string, runs long").where("runs > 0").toDF(dk, kept, runs)
    marked = docs.withColumn(dk, _text_key(F.col("text"))).join(cut, dk, "left")
    changed = F.col(runs) > 0
    fresh = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text")), "n_chars": F.when(changed, F.char_length(kept).cast("long")).otherwise(F.col("n_chars"))}
    return marked.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns])
