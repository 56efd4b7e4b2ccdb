"""SimHash near-dedup: a binary-trie self-join of fingerprints, then connected components.

The distinct fingerprints of a group are a sorted array; a trie node is a range of it. Node
pairs are traversed together, a level of bits at a time, adding up differing bits, and a pair
is dropped once it has more than the Hamming budget. Groups come from the pigeonhole rule:
with a budget of d, two linked fingerprints agree on one of d+1 blocks of bits; a group of
over HOT fingerprints is dealt again by blocks of the remaining bits, which is exact too. Only
distinct fingerprints take part, so copies cost nothing, and each group returns a spanning
forest, not its pairs. Components are contracted by alternating star operations on a DataFrame.

`near_groups` with a similarity (for shingle sets whose SimHash distance varies) takes groups
from min-hash bands instead and checks each link that the trie join proposes by the exact
Jaccard similarity of the shingle sets. A band value of over CROWD texts is dealt in chunks that
share some pivots; what they leave outside its largest component is then compared with all its
chunks, block by block, so a task's memory doesn't grow with the group and no link is lost.
Bands and budget miss a few links. So texts that share a shingle of their Jaccard prefixes and
are in different components still are compared as well, all pairs, which makes the links exact.

Null and wordless texts have fingerprint zero, linked like any other; texts shorter than a
shingle are one shingle. Null keys take part and get the component's smallest non-null key
(null if it has none). Repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.base import free_name, give_back, join_spread, per_text, pieces, slices, small_batches, stage

HOT = 20_000  # fingerprints of a block value that are dealt again
GROUP = 50_000  # fingerprints that one task joins
CROWD, PIVOTS = 1_000, 8  # texts of a band value that one chunk holds, and those that all its chunks share
LARGE = 64  # rows of a group that is given to pivots first
SHINGLES = 400_000  # shingles of texts that one bucket of the prefix filter holds, about
PASSES = 2  # parts of the buckets that the prefix filter shuffles one after the other
WORDS = 1 << 22  # 64-bit words that the shared hashes of one group may take
BANDS, ROWS = 8, 2  # min-hash bands of the variant with a similarity
_SALT = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64 for i in range(BANDS * ROWS)], np.uint64)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[i:] for i in range(n))) if len(words) >= n else [words]
    h = xxhash.xxh64_intdigest
    return np.array([h(b" ".join(p), 42) for p in parts], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set if it is in over half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit number."""
    return per_text(docs, key, "fp long", lambda: lambda ts: [[signed(fingerprint(shingle_hashes(t, shingle))) for t in ts]])


def trie_pairs(fp: np.ndarray, group: np.ndarray, budget: int, most: int = 1 << 16, same: np.ndarray | None = None):
    """Yields index arrays (a, b) of pairs in one group within the budget.

    With `same`, node pairs that have one and the same label throughout are dropped as well. Two
    nodes of one fingerprint each are decided at once by their remaining bits. fp is sorted in each group without repeats, groups are contiguous. At most about `most`
    node pairs are expanded at a time; the others wait on a stack.
    """
    if len(fp) < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(fp)]
    several = ends - starts > 1
    lo, hi = starts[several], ends[several]
    stack = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    ones: dict[int, np.ndarray] = {}
    turns = None if same is None else np.r_[0, np.cumsum(same[1:] != same[:-1])]
    while stack:
        bit, al, ah, bl, bh, d = stack.pop()
        if len(al) > most:
            half = len(al) // 2
            stack += [(bit, *(x[:half] for x in (al, ah, bl, bh, d))), (bit, *(x[half:] for x in (al, ah, bl, bh, d)))]
            continue
        if bit < 0:
            if len(al):
                yield al, bl
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        c = ones[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        own = (al == bl) & (ah == bh)
        other = ~own
        near = other & (d < budget)
        one = d + 1
        children = [
            (al[own], am[own], al[own], am[own], d[own]), (am[own], ah[own], am[own], ah[own], d[own]),
            (al[other], am[other], bl[other], bm[other], d[other]), (am[other], ah[other], bm[other], bh[other], d[other]),
            (al[near], am[near], bm[near], bh[near], one[near]), (am[near], ah[near], bl[near], bm[near], one[near]),
        ]
        if budget > 0:
            children.append((al[own], am[own], am[own], ah[own], one[own]))
        n = [np.concatenate(x) for x in zip(*children)]
        if same is not None and len(n[0]):
            flat = (n[1] > n[0]) & (n[3] > n[2])
            n = [x[flat] for x in n]
            alike = (same[n[0]] == same[n[2]]) & (turns[n[1] - 1] == turns[n[0]]) & (turns[n[3] - 1] == turns[n[2]])
            n = [x[~alike] for x in n]
        leaf = (n[1] - n[0] == 1) & (n[3] - n[2] == 1) & (n[0] != n[2])
        if leaf.any():
            a, b = n[0][leaf], n[2][leaf]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= budget
            if near.any():
                yield a[near], b[near]
        full = (n[1] > n[0]) & (n[3] > n[2]) & ~leaf & ~((n[0] == n[2]) & (n[1] - n[0] < 2))
        stack.append((bit - 1, *(x[full] for x in n)))


class Forest:
    """Union-find over row numbers, vectorised for batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join the ends of each link; which links did so: a forest. A root is its tree's smallest row."""
        place, used = np.arange(len(a)), []
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return np.concatenate(used) if used else place[:0]
            a, b, place = a[apart], b[apart], place[apart]
            high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
            order = np.lexsort((low, high))
            one = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each root goes to its lowest neighbour
            self.root[high[one]] = low[one]
            used.append(place[one])
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]


def _blocks(c: Column, low: int, high: int, parts: int) -> list[Column]:
    """(block number, bits) structs of the bits low..high-1 of c."""
    cuts = [low + (high - low) * i // parts for i in range(parts + 1)]
    take = lambda a, b: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return [F.struct(F.lit(i).alias("n"), take(a, b).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def fingerprint_links(fps: DataFrame, budget: int = 2, hot: int = HOT, group: int = GROUP) -> DataFrame:
    """(u, v): a forest over distinct fingerprints fps(fp) that spans all links within the budget."""
    parts = budget + 1
    total = fps.count()
    blocks = fps.select("fp", F.explode(F.array(*_blocks(F.col("fp"), 0, 64, parts))).alias("b"))
    crowded = blocks.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("b", F.lit(True).alias("crowded"))
    marked = blocks.join(crowded, "b", "left")
    cuts = [64 * i // parts for i in range(parts + 1)]
    again = F.lit(None)
    for i in range(parts):  # the bits outside block i, rotated to the low end, in blocks once more
        a, b = cuts[i], cuts[i + 1]
        low = F.col("fp").bitwiseAND(F.lit((1 << a) - 1)) if a else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned("fp", b), a) if b < 64 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        again = F.when(F.col("b.n") == i, F.array(*_blocks(rest, 0, 64 - (b - a), parts))).otherwise(again)
    none = F.array(F.struct(F.lit(-1).alias("n"), F.lit(0).cast("long").alias("bits")))
    dealt = marked.select("fp", "b", F.explode(F.when(F.col("crowded"), again).otherwise(none)).alias("s"))
    keyed = dealt.select("fp", F.xxhash64("b", "s").alias("g"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        g, fp = pdf["g"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        forest = Forest(len(fp))
        for a, b in trie_pairs(fp, g, budget):
            forest.add(a, b)
        child = np.flatnonzero(forest.root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[child].view(np.int64), "v": fp[forest.root[child]].view(np.int64)})

    n = pieces(parts * total, group)
    return keyed.groupBy(F.pmod("g", F.lit(n)).alias("bucket")).applyInPandas(lambda pdf: join(pdf), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; links(u, v) of longs.

    Alternating large-star and small-star rounds, each written to the shared folder. A node of
    very many links is dealt over several tasks.
    """
    edges = stage(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        per = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
        if per.where((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0))).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_spread(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_spread(large, least, "u", "v").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least)
        edges = stage(small.distinct(), "links")


def _label(prints: DataFrame, roots: DataFrame, key: str, node: str) -> DataFrame:
    """prints with root and component_id: a node that names each component, and its smallest key."""
    distinct = prints.groupBy(node).agg(F.min(key).alias("least"))
    rooted = distinct.join(roots.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = join_spread(rooted, least, "root", node).select(node, "root", "component_id")
    return join_spread(prints, named, node, key)


def simhash_groups(docs: DataFrame, key: str = "doc_id", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(key, fingerprint, component_id) of each row of docs."""
    prints = stage(fingerprints(docs, key, shingle), "fingerprints")
    roots = components(fingerprint_links(prints.select("fp").distinct(), budget))
    named = _label(prints, roots, key, "fp")
    return named.select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _signature(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band: the band's smallest hashes, mixed."""
    out, h = [], np.unique(hashes)
    if not len(h):
        return [0] * BANDS
    mins = []
    for salt in _SALT:
        x = h ^ salt
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        mins.append(int((x ^ (x >> np.uint64(29))).min()))
    for b in range(BANDS):
        out.append(signed(hash((b, *mins[b * ROWS : (b + 1) * ROWS])) % 2**64))
    return out


class Sets:
    """Hash sets of rows, for intersections within a group: bits over what the group's rows share.

    Hashes that only one row of a group has are left out, so a group of near copies needs few
    words a row. A group whose bits would take over WORDS is intersected pair by pair.
    """

    def __init__(self, group: np.ndarray, held: list):
        self.held = [np.frombuffer(x, "<u8") for x in held]
        self.length = np.array([len(x) for x in self.held], np.int64)
        turn = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        number = np.cumsum(turn) - 1
        row = np.repeat(np.arange(len(group)), self.length)
        values = np.concatenate(self.held) if len(row) else np.zeros(0, np.uint64)
        order = np.lexsort((values, number[row]))
        row, values = row[order], values[order]
        own = number[row]
        new = np.r_[True, (own[1:] != own[:-1]) | (values[1:] != values[:-1])][: len(row)]
        shared = np.diff(np.r_[np.flatnonzero(new), len(row)]) > 1  # of each distinct hash of a group
        groups = int(turn.sum())
        each = np.bincount(own[new][shared], minlength=groups)
        width = (each + 63) // 64
        dense = width * np.bincount(number, minlength=groups) <= WORDS
        self.dense, self.width = dense[number], (width * dense)[number]
        self.start = np.r_[0, np.cumsum(self.width)]
        rank = np.cumsum(shared) - 1 - (np.cumsum(each) - each)[own[new]]
        which = np.cumsum(new) - 1
        used = shared[which] & dense[own]
        at, r = row[used], rank[which[used]]
        self.bits = np.zeros(self.start[-1], np.uint64)
        np.bitwise_or.at(self.bits, self.start[at] + (r >> 6), np.uint64(1) << (r & 63).astype(np.uint64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of rows a and b, pair by pair of one group each."""
        out, w = np.zeros(len(a), np.int64), self.width[a]
        ends = np.cumsum(w)
        cuts = np.searchsorted(ends, np.arange(1 << 18, ends[-1] if len(w) else 0, 1 << 18)).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(w)]):
            n = w[lo:hi]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = self.bits[np.repeat(self.start[a[lo:hi]], n) + step] & self.bits[np.repeat(self.start[b[lo:hi]], n) + step]
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n), np.bitwise_count(both), hi - lo).astype(np.int64)
        for i in np.flatnonzero(~self.dense[a]).tolist():
            out[i] = len(np.intersect1d(self.held[a[i]], self.held[b[i]], assume_unique=True))
        return out

    def similar(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether the Jaccard similarity is at least `similarity`; two empty sets are equal."""
        x, y = self.length[a], self.length[b]
        good = similarity * np.maximum(x, y) <= np.minimum(x, y)
        common = self.common(a[good], b[good])
        good[good] = common >= similarity * (x[good] + y[good] - common)
        return good


def _crossed(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, most: int = 1 << 16):
    """Yields row pairs of the pairs of ranges a and b, about `most` at a time; within one range each pair once."""
    tall, wide = last[a] - first[a], last[b] - first[b]
    ends = np.cumsum(tall * wide)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, most):
        flat = np.arange(lo, min(lo + most, int(ends[-1])))
        p = np.searchsorted(ends, flat, "right")
        i, j = np.divmod(flat - (ends[p] - tall[p] * wide[p]), wide[p])
        once = (a[p] != b[p]) | (i < j)
        yield (first[a[p]] + i)[once], (first[b[p]] + j)[once]


def jaccard_links(fp: np.ndarray, group: np.ndarray, node: np.ndarray, held: list, similarity: float, budget: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple]:
    """A forest (node, node) of the pairs in one group whose hash sets are similar enough.

    First the pivots of each large group collect what is like them; then the trie join proposes
    pairs, and those that aren't connected yet are checked. With labels, rows of one label are
    connected already; with sides, only rows of side 1 are compared with those of other sides,
    with side 2 if their node is the smaller one. A budget of 64 bits takes all pairs.
    """
    order = np.lexsort((node, fp, group))
    fp, group, node, held = fp[order], group[order], node[order], [held[i] for i in order]
    forest, sets, out = Forest(len(fp)), Sets(group, held), []
    if label is not None:
        _, at, inverse = np.unique(label[order], return_index=True, return_inverse=True)
        forest.root, side = at[inverse], None if side is None else side[order]

    def link(a: np.ndarray, b: np.ndarray) -> None:
        apart = forest.root[a] != forest.root[b]
        if side is not None:
            apart &= ((side[a] == 1) & ((side[b] == 0) | ((side[b] == 2) & (node[a] < node[b])))) | ((side[b] == 1) & ((side[a] == 0) | ((side[a] == 2) & (node[b] < node[a]))))
        a, b = a[apart], b[apart]
        if len(a):
            good = sets.similar(a, b, similarity)
            a, b = a[good], b[good]
            used = forest.add(a, b)
            out.extend(zip(node[a[used]].tolist(), node[b[used]].tolist()))

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(fp)]
    large = (ends - starts > LARGE) & (label is None)
    for lo, hi in zip(starts[large].tolist(), ends[large].tolist()):
        for _ in range(PIVOTS):  # whatever they leave is for the trie join
            left = np.flatnonzero(forest.root[lo:hi] == np.arange(lo, hi)) + lo
            pivot = left[len(left) // 2]
            near = left[(np.bitwise_count(fp[left] ^ fp[pivot]) <= budget) & (left != pivot)]
            link(np.full(len(near), pivot), near)
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | ((fp[1:] != fp[:-1]) & (budget < 64))])
    last = np.r_[first[1:], len(fp)]
    several = np.flatnonzero(last - first > 1)  # different texts with one fingerprint
    for a, b in _crossed(several, several, first, last):
        link(a, b)
    if budget >= 64:
        return out
    mixed = np.maximum.reduceat(forest.root, first) != np.minimum.reduceat(forest.root, first)
    uniform = np.where(mixed, -1 - first, forest.root[first])
    for x, y in trie_pairs(fp[first], group[first], budget, same=uniform):
        for a, b in _crossed(x, y, first, last):
            link(a, b)
    return out


def text_node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_check(text: Column) -> Column:
    """Another 64 bits of a text's name: the hash starts from another seed."""
    return F.xxhash64(F.lit(1), F.coalesce(text, F.lit("")))


def near_groups(docs: DataFrame, key: str = "doc_id", shingle: int = 5, similarity: float = 0.8, budget: int = 20) -> DataFrame:
    """(key, node, check, root, component_id): groups of texts linked by Jaccard >= similarity of their shingle sets.

    node is the XXH64 of the text, check another one of it: equal texts are one node. Bands and budget find nearly all
    links; the rest are among the texts of `_open_prefixes`.
    """
    noded = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).select("*", text_node(F.col("text")).alias("node"), text_check(F.col("text")).alias("check"))
    texts = noded.select("node", "text")

    def signed_sets():
        def work(ts):
            hashes = [shingle_hashes(t, shingle) for t in ts]
            return [[_signature(h) for h in hashes], [len(h) for h in hashes]]

        return work

    prints = stage(per_text(noded.select(F.struct(key, "node", "check").alias("k"), "text"), "k", "bands array<long>, size long", signed_sets)
                   .select(F.col(f"k.{key}").alias(key), "k.node", "k.check", "bands", "size"), "nodes")
    keyed = prints.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("g"))
    shared = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    wanted = stage(keyed.join(shared, "g").select("node", "g", "parts"), "bands")

    def make():
        def work(ts):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in ts]
            return [[s.astype("<u8").tobytes() for s in sets], [signed(fingerprint(s)) for s in sets]]

        return work

    def linked(rows: DataFrame, texts: DataFrame = texts, budget: int = budget, each: int = 4_000) -> DataFrame:
        """(u, v) of the links in rows(node, g), or those across in rows(node, g, root) or rows(node, g, root, side)."""
        rows = stage(rows, "dealt")
        labels = rows.columns[2:]
        once = texts.groupBy("node").agg(F.first("text").alias("text"))  # copies are merged where they are read; a semi-join would be moved before that
        chosen = once.join(rows.select("node").distinct(), "node")

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            known = [pdf[c].to_numpy() for c in labels]
            out = jaccard_links(pdf["fp"].to_numpy().view(np.uint64), pdf["g"].to_numpy(), pdf["node"].to_numpy(), list(pdf["hashes"]), similarity, budget, *known)
            give_back()
            return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

        whole = rows.join(per_text(chosen, "node", "hashes binary, fp long", make), "node")
        return whole.groupBy(F.pmod("g", F.lit(pieces(rows.count(), each))).alias("bucket")).applyInPandas(lambda pdf: join(pdf), "u long, v long")

    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), "parts").cast("int")
    crowds = wanted.where("parts > 1")
    pivots = crowds.groupBy("g", "parts", F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(PIVOTS)).alias("s")).agg(F.min("node").alias("node"))
    shown = pivots.select("node", "g", chunk.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("chunk")).where("own != chunk")
    dealt = (
        wanted.where("parts = 1").select("node", "g")
        .unionAll(crowds.select("node", F.xxhash64("g", chunk))).unionAll(shown.select("node", F.xxhash64("g", "chunk")))
    )
    links = stage(linked(dealt), "near-links")
    roots = components(links)
    open_rows = _open_crowds(crowds, roots, chunk)
    if not open_rows.isEmpty():
        links = links.unionAll(stage(linked(open_rows), "near-links"))
        roots = components(links)
    total = prints.agg(F.sum("size")).first()[0] or 0
    open_rows = stage(_open_prefixes(texts, roots, total, shingle, similarity), "open")
    if not open_rows.isEmpty():
        few = texts.join(F.broadcast(open_rows.select("node").distinct()), "node", "left_semi")
        blocks = open_rows.where("parts = 1").select("node", "g", "root").unionAll(
            open_rows.where("parts > 1").select("node", "g", "root", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"))
            .where("c != d").select("node", F.xxhash64("g", F.least("c", "d"), F.greatest("c", "d")), "root")
        )
        roots = components(links.unionAll(linked(blocks, few, 64, 1_000)))
    return _label(prints.select(key, "node", "check"), roots, key, "node")


def _open_prefixes(texts: DataFrame, roots: DataFrame, total: int, shingle: int, similarity: float) -> DataFrame:
    """(node, g, root, parts): texts of different components that share a shingle g of their prefixes.

    Of n shingles in an order that is the same for all texts, two similar texts share one of the
    first n - ceil(similarity * n) + 1. Shingles of one component only come first in the order,
    the others by the number of texts that have them, so few texts have any other in the prefix.
    A shingle is named by its bucket and 32 bits; `spare` allows for those that fall together in
    a text: it is what n distinct names have beyond the prefix. One g stands for all with the
    same texts. The buckets are shuffled in PASSES parts, and each part's files are deleted before
    the next; what is alike in most rows (root of an unlinked text, high half of spare) has
    columns of its own that compress to nothing.
    """
    small_batches(texts.sparkSession)
    buckets = pieces(total, SHINGLES)
    rooted = texts.join(F.broadcast(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "text")
    kinds = {"key": "<u4", "node": "<i8", "root": "<i8", "low": "<u2", "high": "<u2"}  # root: what differs from node
    names = ["bucket", *kinds]
    passes = min(PASSES, buckets)

    def deal(batches, turn):
        def flush():
            count = [len(k) for k in keys]
            key = np.concatenate(keys)
            of = np.repeat(np.arange(len(keys)), count)
            order = np.argsort(key >> np.uint64(32), kind="stable")
            key, of = key[order], of[order]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            node, root, spare = (np.array(x, np.int64) for x in zip(*(seen[i] for i in texts)))
            halves = spare.astype("<i4").view("<u2").reshape(-1, 2)
            columns = [low, *(x[of] for x in (node.astype("<i8"), (node ^ root).astype("<i8"), halves[:, 0], halves[:, 1]))]
            parts = [[c[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(key)])] for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=names)

        keys, texts, seen, held = [], [], {}, 0
        for part in (x for b in batches for x in slices(b, "text")):
            for node, root, text in zip(*(part.column(c).to_pylist() for c in ("node", "root", "text"))):
                h = np.unique(shingle_hashes(text, shingle))
                if node in seen or not len(h):
                    continue
                name = np.unique(((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
                seen[node] = node, root, math.ceil(similarity * len(h) - 1e-9) - 1 - (len(h) - len(name))
                mine = name[(name >> np.uint64(32)) % np.uint64(passes) == turn]
                if len(mine):
                    keys.append(mine)
                    texts.append(node)
                    held += len(mine)
            if held > 1 << 20:
                yield flush()
                keys, texts, seen, held = [], [], {}, 0
        if keys:
            yield flush()
        keys, texts, seen = [], [], {}
        give_back()

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node, root, low, high = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in kinds.items())
        root, spare = root ^ node, np.stack([low, high], 1).reshape(-1).view("<i4")
        order = np.argsort(key, kind="stable")
        k = key[order]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        several = np.minimum.reduceat(root[order], starts) != np.maximum.reduceat(root[order], starts)
        order = order[np.repeat(several, np.diff(np.r_[starts, len(k)]))]
        order = order[np.lexsort((node[order], key[order]))]
        k, n = key[order], node[order]
        order = order[np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])][: len(k)]]  # copies of a text
        _, inverse, count = np.unique(key[order], return_inverse=True, return_counts=True)
        g = key[order].astype(np.int64) | (int(pdf["bucket"].iloc[0]) << 32)
        give_back()
        return pd.DataFrame({"node": node[order], "root": root[order], "g": g, "spare": spare[order], "texts": count[inverse]})

    parts = []
    for turn in range(passes):
        dealt = rooted.mapInArrow(lambda it, turn=turn: deal(it, turn), "bucket int, key binary, node binary, root binary, low binary, high binary")
        parts.append(stage(dealt.groupBy("bucket").applyInPandas(lambda pdf: shared(pdf), "node long, root long, g long, spare int, texts long"), "shared"))
    found = reduce(DataFrame.unionAll, parts)
    own = Window.partitionBy("node")
    placed = found.select("*", F.row_number().over(own.orderBy("texts", "g")).alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    prefix = stage(placed.where("place <= n - spare").select("node", "root", "g"), "prefixes")
    per = prefix.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit("y"))).alias("y"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    one = per.where("low != high").groupBy("n", "x", "y").agg(F.min("g").alias("g")).select("g", F.ceil(F.col("n") / CROWD).cast("int").alias("parts"))
    return prefix.join(one, "g").select("node", "g", "root", "parts")


def _open_crowds(crowds: DataFrame, roots: DataFrame, chunk: Column) -> DataFrame:
    """(node, g, root, side): each crowd that isn't one component yet, in blocks.

    Side 1 has the nodes outside the crowd's largest component, side 0 those in it and side 2
    those outside once more. Every block of side 1 meets every chunk but its nodes' own in one
    group g: pairs within a chunk have been compared.
    """
    known = crowds.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = known.groupBy("g", "root").agg(F.count(F.lit(1)).alias("n"))
    still = per.groupBy("g").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    marked = stage(known.join(still, "g").select("node", "g", "parts", "root", "main", F.ceil(F.col("rest") / CROWD).cast("int").alias("rests")), "open")
    own = F.pmod(F.xxhash64("node", F.lit("rest")), "rests").cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = marked.select("node", "g", "root", chunk.alias("c"), to("rests").alias("r"), F.when(F.col("root") == F.col("main"), 0).otherwise(2).alias("side"))
    rest = marked.where("root != main").select("node", "g", "root", chunk.alias("mine"), to("parts").alias("c"), own.alias("r"), F.lit(1).alias("side"))
    rest = rest.where("c != mine").drop("mine")
    return every.unionAll(rest).select("node", F.xxhash64("g", "c", "r").alias("g"), "root", "side")


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one with the smallest key stays.

    A null key comes after all others. Rows that repeat the kept one's key and text go too;
    texts of different groups stay even under one key or none.
    """
    node, check, keep = (free_name(docs, x) for x in ("node", "check", "keep"))
    named = near_groups(docs, key)
    per = named.groupBy("root", "node", "check").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("keep"))).alias("x"))
    least = per.groupBy("root").agg(F.min(F.struct("x", "node", "check")).alias("m")).select("m.node", "m.check", "m.x.keep")
    several = per.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")  # different texts of one 64-bit hash: each stays
    chosen = least.unionAll(per.join(several, "node").select("node", "check", "x.keep")).distinct().toDF(node, check, keep)
    marked = docs.select("*", text_node(F.col("text")).alias(node), text_check(F.col("text")).alias(check))
    kept = marked.join(chosen, [marked[node] == chosen[node], marked[check] == chosen[check], marked[key].eqNullSafe(chosen[keep])], "left_semi")
    return kept.dropDuplicates([node, check, key]).select(*docs.columns)
