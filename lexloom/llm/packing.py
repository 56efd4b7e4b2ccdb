"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most CAPACITY tokens; full pieces are sequences of their
own. The others are dealt to shards of about SHARD pieces. On each shard, ISLANDS populations
of packings evolve: a crossover takes whole well-filled bins, the best first, from two parents,
skips bins that would repeat a piece, and puts the displaced pieces back best-fit; a mutation
empties bins and matches their pieces anew, two or three to an exact fill. The fitness is the
number of bins, then the mean squared fill. After each epoch every island keeps its population
and gets its neighbour's elite. The first individual is best-fit decreasing, so a packing is
never worse than that, and where that is at the lower bound nothing evolves.

Null texts count as empty (one piece: the end token). Repeated rows are pieces of their own.
Pieces that agree in all columns are interchangeable. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.base import per_text, pieces, stage

CAPACITY = 1024
END_ID = 2
SHARD = 8192
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 6
WELL = 0.97  # share of its capacity that a well-filled bin has
SLACK = 8  # tokens that a matched bin may lack
BIN_SPACE = 1 << 32  # sequence ids of a shard


def special_strings(path: str) -> tuple[str, ...]:
    """The strings that `tokenizers` maps to special tokens wherever a text has them."""
    from tokenizers import Tokenizer

    return tuple(t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values())


@functools.lru_cache(2)
def load_tokenizer(path: str, ranks_path: str | None = None, pattern: str | None = None, special: tuple[str, ...] = ()):
    """texts -> id lists, as `tokenizers` gives them without added special tokens; one a worker.

    With the same vocabulary as tiktoken ranks, tiktoken does the work; texts that hold a
    special string go to `tokenizers`, which is loaded when the first such text comes.
    """

    @functools.cache
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    if not ranks_path:
        return lambda texts: [x.ids for x in slow().encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(texts):
        return [slow().encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

    return encode


def token_pieces(docs: DataFrame, tokenizer, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32): tokenizer() gives a function from texts to id lists."""

    def make():
        encode = tokenizer()

        def work(texts):
            rows = []
            for ids in encode([t or "" for t in texts]):
                ids = np.array([*ids, END_ID], "<u4")
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                ends = [*starts[1:], len(ids)]
                rows.append([{"piece": i, "start": a, "length": e - a, "ids_crc32": zlib.crc32(ids[a:e].tobytes())} for i, (a, e) in enumerate(zip(starts, ends))])
            return [rows]

        return work

    found = per_text(docs, key, "pieces array<struct<piece:int,start:long,length:long,ids_crc32:long>>", make)
    return found.select(key, F.explode("pieces").alias("x")).select(key, "x.*")


class Open:
    """Bins with room, by room; best fit is the least room that is enough."""

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size = bins, size
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room
        self.rooms: list[int] = []  # rooms that some bin has, sorted
        for b, items in enumerate(bins):
            self._put(b, capacity - sum(size[i] for i in items))

    def _put(self, b: int, room: int) -> None:
        if room:
            if not self.at[room]:
                insort(self.rooms, room)
            self.at[room].append(b)

    def add(self, items: list[int]) -> None:
        size, rooms, at = self.size, self.rooms, self.at
        for i in items:
            k = bisect_left(rooms, size[i])
            if k == len(rooms):
                self.bins.append([i])
                self._put(len(self.bins) - 1, self.capacity - size[i])
                continue
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del rooms[k]
            self.bins[b].append(i)
            self._put(b, room - size[i])


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def _exact(count: np.ndarray, there: np.ndarray, room: int, rng) -> list[int] | None:
    """One or two sizes that are there and fill the room exactly; of several pairs any."""
    if there[room]:
        return [room]
    half = room // 2
    found = (there[1 : half + 1] & there[room - half : room][::-1]).nonzero()[0]
    if len(found) and 2 * (found[-1] + 1) == room and count[half] < 2:
        found = found[:-1]
    if not len(found):
        return None
    a = int(found[int(rng.integers(len(found)))]) + 1
    return [room - a, a]


def matched(items: list[int], size: list[int], capacity: int, rng) -> list[list[int]]:
    """Bins built around the largest piece left, filled exactly where two more pieces can, else nearly."""
    by: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in items:
        by[size[i]].append(i)
    count = np.array([len(x) for x in by])
    there = count > 0
    bins, largest = [], capacity

    def take(x: int) -> None:
        count[x] -= 1
        there[x] = count[x] > 0

    while True:
        while largest and not there[largest]:
            largest -= 1
        if not largest:
            return bins
        chosen, room = [largest], capacity - largest
        take(largest)
        while room:
            pick = next((x for r in range(room, max(0, room - SLACK), -1) if (x := _exact(count, there, r, rng))), None)
            if pick is None:
                fits = there[: room + 1].nonzero()[0]
                if not len(fits):
                    break
                pick = [int(fits[-min(len(fits), int(rng.geometric(0.5)))])]
            for x in pick:
                take(x)
            chosen += pick
            room -= sum(pick)
            if len(pick) == 2:
                break
        bins.append([by[x].pop() for x in chosen])


def crossover(one, two, size, capacity, rng) -> list[list[int]]:
    """Whole well-filled bins of both parents, the best first; displaced pieces best-fit, the largest first."""
    filled = [(sum(size[i] for i in b), k) for k, b in enumerate(one)] + [(sum(size[i] for i in b), k + len(one)) for k, b in enumerate(two)]
    noise = rng.random(len(filled))
    order = sorted((k for k in range(len(filled)) if filled[k][0] >= WELL * capacity), key=lambda k: (-filled[k][0], noise[k]))
    used, bins = bytearray(len(size)), []
    for k in order:
        b = one[k] if k < len(one) else two[k - len(one)]
        if any(used[i] for i in b):
            continue
        bins.append(b[:])
        for i in b:
            used[i] = 1
    packed = Open(bins, size, capacity)
    packed.add([i for i in range(len(size)) if not used[i]])  # sizes fall with the index
    return packed.bins


def mutate(bins, size, capacity, rng) -> list[list[int]]:
    """Empty the bins with room and some full ones; match their pieces anew."""
    full = [k for k, b in enumerate(bins) if sum(size[i] for i in b) == capacity]
    some = rng.random(len(full)) < rng.choice((0.02, 0.1, 0.3))
    stay = {k for k, out in zip(full, some) if not out}
    kept = [b[:] for k, b in enumerate(bins) if k in stay]
    return kept + matched(sorted(i for k, b in enumerate(bins) if k not in stay for i in b), size, capacity, rng)


def founders(size: list[int], capacity: int, rng, population: int = POPULATION) -> list[list[list[int]]]:
    """A first population: best-fit decreasing, and where that has more bins than the lower bound a matched packing and mutations."""
    first = Open([], size, capacity)
    first.add(list(range(len(size))))
    people = [first.bins]
    if len(first.bins) > lower_bound(size, capacity):
        people.append(matched(list(range(len(size))), size, capacity, rng))
        people += [mutate(first.bins, size, capacity, rng) for _ in range(population - 2)]
    return people


def lower_bound(size: list[int], capacity: int) -> int:
    """No packing has fewer bins. For each k: pieces above capacity - k share no bin with one of k or
    more; other pieces above half a bin need one each, and what of the rest doesn't fit there needs more."""
    n = np.bincount(np.array(size, np.int64), minlength=capacity + 1)
    number, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * np.arange(capacity + 1))]
    k, half = np.arange(1, capacity // 2 + 1), capacity // 2
    alone = number[-1] - number[capacity - k + 1]
    middle, filled = number[capacity - k + 1] - number[half + 1], total[capacity - k + 1] - total[half + 1]
    more = total[half + 1] - total[k] - (middle * capacity - filled)
    return int(max(-(-total[-1] // capacity), (alone + middle + np.maximum(0, -(-more // capacity))).max(initial=0)))


def evolve(size: list[int], capacity: int, seed: int, people=None, migrant=None, generations: int = GENERATIONS, population: int = POPULATION):
    """An island's population after some generations, the best first; sizes fall.

    No generation runs once the lower bound is reached: no bin can be saved then.
    """
    rng = np.random.default_rng(seed)
    least = lower_bound(size, capacity)
    score = lambda b: fitness(b, size, capacity)
    people = [*(people or founders(size, capacity, rng, population))]
    if migrant is not None:
        people.append(migrant)
    scored = sorted(((score(p), k) for k, p in enumerate(people)), reverse=True)[:population]
    people, scores = [people[k] for _, k in scored], [s for s, _ in scored]
    for _ in range(generations):
        if -scores[0][0] <= least or len(people) < 2:
            break
        a = people[int(rng.integers(0, max(1, len(people) // 2)))]
        b = people[int(rng.integers(0, len(people)))]
        child = crossover(a, b, size, capacity, rng)
        child = max(child, mutate(child, size, capacity, rng), mutate(a, size, capacity, rng), key=score)
        new = score(child)
        if new > scores[-1] and new not in scores:  # one of each fitness: the population stays diverse
            at = next(k for k, s in enumerate(scores) if new > s)
            people.insert(at, child)
            scores.insert(at, new)
            if len(people) > population:
                people.pop()
                scores.pop()
    return people


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    by = ["length", "k", "piece", "ids_crc32"]
    return pdf.sort_values(by, ascending=[False, True, True, True], kind="stable")


def _to_numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, "<i4")
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _to_bins(numbers: np.ndarray) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(int(numbers.max()) + 1)] if len(numbers) else []
    for i, b in enumerate(numbers.tolist()):
        bins[b].append(i)
    return bins


def pack(found: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """found (token_pieces) with sequence_id and offset."""
    kind = found.schema[key].dataType.simpleString()
    found = stage(found.select(F.col(key).cast("string").alias("k"), "piece", "start", "length", "ids_crc32"), "token-pieces")
    full = found.where(F.col("length") >= capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = found.where(F.col("length") < capacity)
    shards = pieces(small.count(), shard)
    small = small.withColumn("shard", F.pmod(F.xxhash64("k", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    small = stage(small, "shards")
    sizes = small.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))  # islands need lengths only
    lengths = sizes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("m"), "n"))).alias("sizes"))
    islands = lengths.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    state = islands.select("*", F.lit(None).cast("array<binary>").alias("people"), F.lit(None).cast("binary").alias("migrant"))

    def epoch(number: int):
        def run(batches):
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    size = [-x["m"] for x in r.sizes for _ in range(x["n"])]
                    people = None if r.people is None else [_to_bins(np.frombuffer(x, "<i4")) for x in r.people]
                    migrant = None if r.migrant is None else _to_bins(np.frombuffer(r.migrant, "<i4"))
                    best = evolve(size, capacity, int(r.shard) * 1000 + number * 100 + int(r.island), people, migrant)
                    packed = [_to_numbers(p, len(size)).tobytes() for p in best]
                    out.append((r.shard, r.island, packed, packed[0], len(best[0]), fitness(best[0], size, capacity)[1], len(best[0]) <= lower_bound(size, capacity)))
                yield pd.DataFrame(out, columns=["shard", "island", "people", "elite", "bins", "fill", "optimal"])

        return run

    ddl = "shard long, island int, people array<binary>, elite binary, bins int, fill double, optimal boolean"
    for number in range(EPOCHS):  # an island keeps its population and gets its neighbour's elite
        spread = state.repartition(ISLANDS * shards, "shard", "island")
        done = stage(spread.select("shard", "sizes", "island", "people", "migrant").mapInPandas(epoch(number), ddl), "elites")
        if number == 0 and done.where("not optimal").isEmpty():
            break
        moved = done.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
        state = islands.join(done.select("shard", "island", "people"), ["shard", "island"]).join(moved, ["shard", "island"])
    best = done.groupBy("shard").agg(F.max_by("elite", F.struct(-F.col("bins"), "fill", "island")).alias("elite"))

    def assign(own: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        own = _sorted(own).reset_index(drop=True)
        number = np.frombuffer(elite["elite"].iloc[0], "<i4").astype(np.int64)
        order = np.argsort(number, kind="stable")
        length = own["length"].to_numpy()[order]
        ends = np.cumsum(length)
        first = np.r_[True, np.diff(number[order]) != 0]
        offset = np.empty(len(own), np.int64)
        offset[order] = ends - length - np.repeat((ends - length)[first], np.diff(np.r_[np.flatnonzero(first), len(own)]))
        out = own[["k", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = own["shard"].to_numpy() * BIN_SPACE + number
        out["offset"] = offset
        return out

    ddl = "k string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = small.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(lambda a, b: assign(a, b), ddl)
    return full.unionByName(packed).select(F.col("k").cast(kind).alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer, key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document, packed."""
    return pack(token_pieces(docs, tokenizer, key), key)
