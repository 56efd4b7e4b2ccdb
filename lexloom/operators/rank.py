"""Line ranking: the best segmentation of each line into phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.normalize import ascii_line
from lexloom.functions.symbols import END, PB, visible
from lexloom.operators.index import MAX_SYMBOLS
from lexloom.operators.search import RESTART

MAX_STEPS = 100_000


def segment(letters: str, needed: set[int], found, total: int, restart: float = RESTART) -> tuple[float, str] | None:
    """The best (score, text): found has (start, [(text, at a space, cnt)]); needed holds the
    letter positions before which the line has a space. Inner segments end at a space.
    """
    n = len(letters)
    best: list[tuple[float, str] | None] = [None] * (n + 1)
    best[0] = (1.0, "")
    result = None
    better = lambda new, old: old is None or (-new[0], new[1]) < (-old[0], old[1])
    for start, variants in sorted(found, key=lambda x: x[0]):
        if best[start] is None:
            continue
        scale, begun = best[start]
        for text, spaced, cnt in variants:
            at, inner = start, set()
            for ch in text:
                if ch == " ":
                    inner.add(at)
                else:
                    at += 1
            if not {p for p in needed if start < p < at} <= inner:
                continue
            if at == n and better(new := (scale * cnt, begun + text), result):
                result = new
            if spaced and at < n and better(new := (scale * (cnt / total) * restart, f"{begun}{text} "), best[at]):
                best[at] = new
    return result


def rank_lines(lines: DataFrame, phrases: DataFrame, total: int, max_steps: int = MAX_STEPS, order: bool = True) -> DataFrame:
    """(score, line_number, text) of lines(line_number, line).

    Score 0 and the normalised text where nothing fits, -1 where more than max_steps phrases
    would have to be tried. Sorted by falling score, then by line, unless order is off.
    """
    norm = lines.select("line_number", ascii_line(F.coalesce("line", F.lit(""))).alias("norm")).withColumn("letters", F.replace("norm", F.lit(" "), F.lit("")))
    starts = F.transform(F.sequence(F.lit(0), F.char_length("letters") - 1), lambda i: i)
    spans = norm.where("letters <> ''").select("letters", F.explode(starts).alias("start")).distinct()
    size = F.least(F.lit(MAX_SYMBOLS), F.char_length("letters") - F.col("start"))
    parts = spans.select("letters", "start", F.explode(F.sequence(F.lit(1), size)).alias("n")).select("letters", "start", F.substring("letters", F.col("start") + 1, F.col("n")).alias("word"))
    usable = phrases.where(~F.contains("phrase", F.lit(PB)))
    word = F.translate("phrase", f" {END}", "")  # only words of ASCII letters and digits can equal a part of a line
    variants = usable.select(
        word.alias("word"), F.struct(F.rtrim(visible(F.col("phrase"))).alias("text"), F.col("phrase").endswith(" ").alias("spaced"), "cnt").alias("v")
    )
    hits = parts.join(variants, "word").groupBy("letters", "start").agg(F.collect_list("v").alias("vs"))
    per_line = hits.groupBy("letters").agg(F.collect_list(F.struct("start", "vs")).alias("found"))

    @F.pandas_udf("struct<score:double,text:string>")
    def best(norms, founds):
        import pandas as pd

        rows = []
        for said, found in zip(norms, founds):
            found = [] if found is None else [(x["start"], [(v["text"], v["spaced"], v["cnt"]) for v in x["vs"]]) for x in found]
            if sum(len(v) for _, v in found) > max_steps:
                rows.append((-1.0, said))
                continue
            at, needed = 0, set()
            for ch in said:
                if ch == " ":
                    needed.add(at)
                else:
                    at += 1
            rows.append(segment(said.replace(" ", ""), needed, found, total) or (0.0, said))
        return pd.DataFrame(rows, columns=["score", "text"])

    scored = norm.join(per_line, "letters", "left").select("line_number", best("norm", "found").alias("r")).select("r.score", "line_number", "r.text")
    return scored.orderBy(F.desc("score"), "line_number") if order else scored


def rank_with(lines: DataFrame, ranker) -> DataFrame:
    """rank_lines with a callable of one's own: line -> (score, text)."""

    def run(batches):
        for b in batches:
            found = [ranker(x or "") for x in b["line"]]
            yield b[["line_number"]].assign(score=[float(f[0]) for f in found], text=[f[1] for f in found])[["score", "line_number", "text"]]

    return lines.select("line_number", "line").mapInPandas(run, "score double, line_number long, text string")

