"""The phrase index: chains, counts, boundary phrases, prefixes, save and load, merge and cutoff."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.normalize import Normalizer
from lexloom.functions.symbols import BOUNDARY, END, PB, spelled, terminator
from lexloom.operators import runs
from lexloom.sources.staging import compact

MAX_SYMBOLS = 40
METADATA = {"format_version": 2, "flags": 0, "normalization_profile": 1, "max_chain_symbols": MAX_SYMBOLS, "title_multiplier": 10, "unicode_version": "16.0"}


def chains(text: Column, cap: int = MAX_SYMBOLS, where: str = "", first: int | None = None) -> Column:
    """The chains of a normalised line, as an array, without the end mark.

    A chain starts at each word or position and every `cap` symbols of an unbroken run, and has
    at most `cap` visible symbols; boundaries at its end are cut. It is an empty string where
    `where`, a regular expression, doesn't hold at its beginning. first: only so many symbols of
    each, which is enough for the phrases that have fewer.
    """
    v, b = f"[^ {PB}]", f"[ {PB}]"
    chain = f"(?=({v}(?:{b}?{v}){{0,{min(cap, first or cap) - 1}}}))"
    return F.regexp_extract_all(text, F.lit(f"{f'(?:(?={where}){chain})?+' if where else chain}{v}{{1,{cap}}}"), 1)


def occurrences(lines: DataFrame, text: str = "text", weight: str | None = None, cap: int = MAX_SYMBOLS, where: str = "", first: int | None = None) -> DataFrame:
    """(chain, cnt): a row for each occurrence of a chain. What adds counts up takes these as well as an index.

    where: a regular expression that holds at the beginning of the chains which are wanted, if not
    all are; first: how many symbols of each, if not all.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    found = lines.select(F.explode(chains(F.col(text), cap, where, first)).alias("chain"), w.alias("cnt"))
    return found.where("chain <> ''") if where else found


def sampled(lines: DataFrame, text: str = "text", weight: str | None = None, cap: int = MAX_SYMBOLS, make=lambda few: few, where: str = "", first: int | None = None) -> tuple[DataFrame, float]:
    """occurrences() of a bounded sample of lines, and their share: for the bounds of ranges alone.

    make: what is still to be done to the lines, so that it is done to the sample alone.
    """
    f = min(1.0, runs.SAMPLE_LINES / max(lines.count(), 1))
    return occurrences(make(lines.sample(f, 7) if f < 1 else lines), text, weight, cap, where, first), f


def chain_counts(lines: DataFrame, text: str = "text", weight: str | None = None, cap: int = MAX_SYMBOLS, sample: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(chain, cnt): weighted number of occurrences, in the order of walk(); the sum fails on overflow."""
    return runs.chains(occurrences(lines, text, weight, cap), sample or sampled(lines, text, weight, cap))


_MARK = re.compile(BOUNDARY)


def _fold(batches, least: int | None, whole: bool):
    """Rows of runs.FOLDED from sorted rows (p, n, below): counts of boundary prefixes.

    Only the prefixes of the row at hand are open, in a stack of at most a chain's depth. least
    None: every prefix has all counts below it. Otherwise one with fewer adds its count to the
    prefix before. What may go on in a neighbouring partition (prefixes of this one's first or
    last row) isn't done unless this partition is the whole.
    """
    stack: list[list] = []
    first = None
    rows: list[tuple] = []

    def close() -> None:
        p, n, below = stack.pop()
        if not whole and first.startswith(p):
            if n or below:
                rows.append((p, n, below, False))
            if least is None and stack:
                stack[-1][1] += n
            return
        if least is None:
            rows.append((p, n, below, True))
            if stack:
                stack[-1][1] += n
            return
        emit = n >= least or (n > 0 and below)
        if emit:
            rows.append((p, n, below, True))
        if stack:
            stack[-1][1] += 0 if emit else n
            stack[-1][2] |= emit or below

    def batch():
        columns = list(zip(*rows)) if rows else [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["p", "n", "below", "done"])

    for b in batches:
        for p, n, below in zip(*(c.to_pylist() for c in b.columns)):
            if first is None:
                first = p
            while stack and not p.startswith(stack[-1][0]):
                close()
            for m in _MARK.finditer(p, len(stack[-1][0]) if stack else 0):
                stack.append([p[: m.end()], 0, False])
            if stack:
                stack[-1][1] += n
                stack[-1][2] |= below
            if len(rows) > 10_000:
                yield batch()
    while stack:
        if whole:
            close()
            continue
        p, n, below = stack.pop()
        if n or below:
            rows.append((p, n, below, False))
        if least is None and stack:
            stack[-1][1] += n
    yield batch()


def _ranges(rows: DataFrame, parts: int | None = None) -> DataFrame:
    spread = rows.repartitionByRange(parts, "p") if parts else rows.repartitionByRange("p")
    return spread.select("p", "n", "below").sortWithinPartitions("p")


def boundary_phrases(counts: DataFrame, stage=None, sample: tuple[DataFrame, float] | None = None) -> DataFrame:
    """(phrase, cnt): phrase ends with its boundary mark; cnt is the total below that prefix.

    Chains are sorted by ranges and each partition adds up its own prefixes; only those at a
    partition's edges are added up across partitions. `stage` may write that, or it is done twice.
    """
    folded = runs.folded(counts, None, sample)
    return joined_edges(stage(folded, "prefixes") if stage else folded)


def joined_edges(folded: DataFrame) -> DataFrame:
    """(phrase, cnt) of rows of runs.FOLDED."""
    edges = folded.where("not done").groupBy("p").agg(F.sum("n").alias("n"))
    return folded.where("done").select("p", "n").unionAll(edges).select(F.col("p").alias("phrase"), F.col("n").alias("cnt"))


def with_text(phrases: DataFrame) -> DataFrame:
    """(text, terminator, cnt)."""
    return phrases.select(F.regexp_replace("phrase", f"{BOUNDARY}$", "").alias("text"), terminator(F.col("phrase")).alias("terminator"), "cnt")


def prefix_counts(counts: DataFrame, depth: int, path: str = "") -> DataFrame:
    """(prefix, parent, symbol, cnt, sibling_rank): prefixes below a path, down to `depth` symbols."""
    whole = F.concat("chain", F.lit(END))
    below = counts.where(F.col("chain").startswith(path)) if path else counts
    lengths = F.sequence(F.lit(1), F.least(F.lit(depth), F.char_length(whole)))
    found = below.select(F.explode(F.transform(lengths, lambda n: F.substring(whole, F.lit(1), n))).alias("prefix"), "cnt").groupBy("prefix").agg(F.sum("cnt").alias("cnt"))
    split = found.select("prefix", F.substring("prefix", F.lit(1), F.char_length("prefix") - 1).alias("parent"), F.right("prefix", F.lit(1)).alias("symbol"), "cnt")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("cnt"), "symbol"))
    return split.withColumn("sibling_rank", rank)


def explore(counts: DataFrame, path: str = "", depth: int | None = None, normalizer: Normalizer | None = None) -> DataFrame:
    """(prefix, parent, symbol, cnt, sibling_rank): the nodes along a typed path, and below it down to `depth`.

    The path is normalised as a query literal, with position breaks as the index has them. The
    depth counts from the root and is the path's length if not given, so an empty path gives
    no node. Siblings rank by falling count, then by symbol.
    """
    if depth is not None and depth <= 0:
        raise ValueError("depth must be positive")
    typed = (normalizer or Normalizer([])).typed(path)
    depth = len(typed) if depth is None else depth
    if not depth:
        return prefix_counts(counts, 1).limit(0)
    found = prefix_counts(counts, depth, typed[:depth])
    return found.where(F.char_length("prefix") > len(typed)).unionByName(found.where(F.lit(typed).startswith(F.col("prefix"))))


def children(counts: DataFrame, parent: str, least: str = "", most: str = PB) -> DataFrame:
    """(symbol, cnt): the symbols after a prefix, in a range."""
    below = counts.withColumn("whole", F.concat("chain", F.lit(END))).where(F.col("whole").startswith(parent))
    symbol = F.substring("whole", len(parent) + 1, 1)
    return below.select(symbol.alias("symbol"), "cnt").where(F.col("symbol").between(least, most) & (F.col("symbol") != "")).groupBy("symbol").agg(F.sum("cnt").alias("cnt"))


def alphabet(counts: DataFrame) -> DataFrame:
    """(symbol): the distinct visible symbols, space included."""
    return counts.select(F.explode(F.split("chain", "")).alias("symbol")).where((F.col("symbol") != "") & (F.col("symbol") != PB)).distinct()


def total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def walk(counts: DataFrame, in_order: bool = False) -> DataFrame:
    """(chain, cnt) in the order of the symbols, the end mark included: letters, end, position break.

    in_order: counts have that order already, as those of chain_counts() and merge().
    """
    found = counts.select(F.concat("chain", F.lit(END)).alias("chain"), "cnt")
    return found if in_order else found.orderBy("chain")


def dump(counts: DataFrame, in_order: bool = False) -> DataFrame:
    """(cnt, chain) in the order of walk(), with marks spelled out."""
    return walk(counts, in_order).select("cnt", spelled(F.col("chain")).alias("chain"))


def save(counts: DataFrame, path: str, metadata: dict | None = None, in_order: bool = False) -> None:
    """Chains in order, and a one-row metadata table; an existing path is an error."""
    spark = counts.sparkSession
    rows = counts if in_order else runs.chains(counts)
    compact(rows.write).mode("errorifexists").parquet(f"{path}/chains")
    spark.createDataFrame([tuple((metadata or METADATA).values())], list((metadata or METADATA))).coalesce(1).write.mode("errorifexists").parquet(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The chains of a saved index; its metadata, columns and counts are checked first."""
    meta = [r.asDict() for r in spark.read.parquet(f"{path}/metadata").limit(2).collect()]
    if len(meta) != 1 or set(meta[0]) != set(METADATA):
        raise ValueError(f"{path} has no metadata of an index")
    for name in ("format_version", "flags", "normalization_profile", "max_chain_symbols", "title_multiplier"):
        if meta[0][name] != METADATA[name]:
            raise ValueError(f"{path} has {name} {meta[0][name]}, not {METADATA[name]}")
    chains = spark.read.parquet(f"{path}/chains")
    if [(f.name, f.dataType.simpleString()) for f in chains.schema] != [("chain", "string"), ("cnt", "bigint")]:
        raise ValueError(f"{path} has other columns than chain and cnt")
    if not chains.where("chain is null or chain = '' or cnt is null or cnt < 1").isEmpty():
        raise ValueError(f"{path} has an empty chain or a count below 1")
    return chains


def merge(*indexes: DataFrame) -> DataFrame:
    """(chain, cnt): the sums over all indexes, in the order of walk()."""
    return runs.chains(reduce(DataFrame.unionByName, indexes))


def same_metadata(spark: SparkSession, paths: list[str]) -> None:
    if len({tuple(sorted(spark.read.parquet(f"{p}/metadata").first().asDict().items())) for p in paths}) != 1:
        raise ValueError("the indexes differ in their metadata")


def merge_saved(spark: SparkSession, paths: list[str], cutoff: int = 1, stage=None) -> DataFrame:
    """The merged index of saved ones with equal metadata."""
    same_metadata(spark, paths)
    parts = [load(spark, p) for p in paths]
    return cut_off(reduce(DataFrame.unionByName, parts), cutoff, stage) if cutoff > 1 else merge(*parts)


def merge_rounds(spark: SparkSession, paths: list[str], fan_in: int = 200, between: int = 2, final: int = 5, stage=None) -> DataFrame:
    """Batches of fan_in with the cutoff `between` until so few are left, which get `final`; batches lose what stays below.

    A final cutoff of 1 drops nothing, as no count of an index is less; the result is in order then.
    """
    parts, saved = [lambda p=p: load(spark, p) for p in paths], True
    same_metadata(spark, paths)
    while len(parts) > fan_in:
        batches = [parts[i : i + fan_in] for i in range(0, len(parts), fan_in)]
        done = [cut_off(reduce(DataFrame.unionByName, (p() for p in b)), between, stage, in_order=saved and len(b) == 1) for b in batches]
        parts, saved = [lambda d=d: d for d in done], False
    last = [p() for p in parts]
    return cut_off(reduce(DataFrame.unionByName, last), final, stage) if final > 1 else merge(*last)


EDGE_ROWS = 1_000_000  # rows that one task folds at the end


def cut_off(counts: DataFrame, least: int, stage=None, sample: tuple[DataFrame, float] | None = None, in_order: bool = False) -> DataFrame:
    """(chain, cnt): counts below `least` roll up to the prefix at the boundary before.

    A prefix is kept once it has `least`, or some and a longer one is kept; what reaches the
    empty prefix is lost. Equal chains are added up first, so parts of an index need no merge
    before. Chains are sorted by ranges and each partition decides its own prefixes; those at its
    edges (a chain's depth at each) go on to a next round, until few are left. `stage` may write
    each round, or rounds are computed again. in_order: counts are those of one saved index, whose
    files have a range each, and aren't shuffled.
    """
    keep = stage or (lambda df, name: df)
    out, folded = [], keep(runs.folded_in_order(counts, least) if in_order else runs.folded(counts, least, sample), "cutoff")
    while True:
        out.append(folded.where("done").select(F.regexp_replace("p", f"{END}$", "").alias("chain"), F.col("n").alias("cnt")))
        rows = folded.where("not done")
        if len(out) > 1 and parts == 1:
            return reduce(DataFrame.unionByName, out)
        parts = -(-rows.count() // EDGE_ROWS) or 1  # fewer by far each round: two chains' depths for a partition
        folded = keep(_ranges(rows, parts).mapInArrow(lambda it, whole=parts == 1: _fold(it, least, whole), runs.FOLDED), "cutoff")
