"""Corpus sources and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

TITLE_WEIGHT = 10


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make fewer partitions than there are; no shuffle otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line) of the text files under a path, whatever its depth.

    line_no rises within a block of a file, block within a file, and file as the sorted list.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def document_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no, line): one row per line of each document."""
    return docs.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of the pages of a wiki XML dump."""
    found = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text string>, text string").load(path)
    return found.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("revision.text", "text", F.lit("")).alias("text"))


def marked_lines(lines: DataFrame, group: Column | str, *order: Column | str) -> DataFrame:
    """(text, weight) of lines with article markers: titles weigh TITLE_WEIGHT, end markers go.

    `BEGIN ARTICLE:` is followed by its title; the line after `<doc ` is one. Lines are in order
    within a group, as a file: text_lines has group `file`, order `block` and `line_no`.
    """
    w = Window.partitionBy(group).orderBy(*(order or ("line_no",)))
    line, before = F.col("line"), F.lag("line").over(w)
    begin, opens = line.startswith("BEGIN ARTICLE:"), line.startswith("<doc ")
    after_doc = F.coalesce(before.startswith("<doc "), F.lit(False))
    marked = lines.withColumn("after", after_doc)
    title = begin | F.col("after")
    skip = ~F.col("after") & (opens | line.startswith("END ARTICLE:") | line.startswith("</doc>"))
    text = F.when(begin & ~F.col("after"), F.substring(line, len("BEGIN ARTICLE:") + 1, 1 << 30)).otherwise(line)
    return marked.where(~skip).select(text.alias("text"), F.when(title, TITLE_WEIGHT).otherwise(1).alias("weight"))


def general_number(x: Column) -> Column:
    """A number with eight significant digits, without zeros at its end, by built-in functions."""
    said = F.format_string("%.7e", F.abs(x))
    power = F.substring_index(said, "e", -1).cast("int")
    digits = F.replace(F.substring_index(said, "e", 1), F.lit("."), F.lit(""))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    point = lambda at: F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, F.lit(8)))
    fixed = F.when(power >= 0, point(power + 1)).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
    science = F.concat(trimmed(point(F.lit(1))), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.when((power < -4) | (power >= 8), science).otherwise(trimmed(fixed))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), size))


def result_lines(results: DataFrame, observation: Observation | None = None) -> DataFrame:
    """(value): `score text` with trailing spaces cut, for write.text; an observation counts the rows as `written`."""
    lines = results.select(F.concat_ws(" ", general_number(F.col("score")), F.rtrim("text")).alias("value"))
    return lines.observe(observation, F.count(F.lit(1)).alias("written")) if observation else lines


def write_ranked(ranked: DataFrame, path: str) -> None:
    """score, line and text, tab-separated; an existing path is an error."""
    ranked.select("score", "line_number", "text").write.csv(path, sep="\t", mode="errorifexists")


def page(results: DataFrame, start: int = 0, num: int = 100) -> DataFrame:
    """Rows start .. start+num-1 of results, best score first, ties by text."""
    return results.orderBy(F.desc("score"), "text").offset(start).limit(num)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file with this content; an existing one is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
