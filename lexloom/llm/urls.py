"""URL filter: longest matching host/path rule first, else a character language-model ratio.

DataFrame functions only. Two Witten-Bell smoothed variable-order Markov models (contexts of
two, one and no characters) are counted from the URLs that the rules decide: `allow` URLs make
the accepted model, `block` URLs the rejected one. Characters fold to an alphabet of fixed
size, so the table of log-ratios has len(ALPHABET)**3 cells however large the input is: an array
that each row looks up, so scoring moves no rows. A URL's score is the mean log-ratio per
character; one in CALIBRATE of the distinct rule-decided URLs is held out of the models, and the
cut is calibrated on those.

Null URLs and URLs without `://` have an empty host and path, match no rule and are scored
like an empty string. If either class has no held-out URL, every undecided URL is allowed. Repeated
rows are judged alike, each on its own row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.base import ascii_lower, stage

#: (verdict, host, path): fixed values of the filter.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Index 0 pads the start, 1 marks the end, the last stands for any other character.
ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0123456789./-_?=&%#:*"
_A = len(ALPHABET)
UNIT = 1 << 20  # log-ratios are whole numbers of 1/UNIT, so that sums don't depend on their order
CALIBRATE = 5
_AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, _AUTHORITY, 1)), F.regexp_extract(u, _AUTHORITY, 2)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _codes(url: Column) -> Column:
    """Alphabet indexes of the URL's characters, between two start marks and an end mark."""
    folded = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), r"[^a-z0-9./\-_?=&%#:]", "*")
    chars = F.filter(F.split(folded, ""), lambda c: c != "")
    start = F.array(F.lit(0), F.lit(0))
    return F.concat(start, F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c) - 1), F.array(F.lit(1)))


def _grams(codes: Column) -> Column:
    """Numbers of the three-character grams; the outer transform evaluates the codes once."""
    return F.transform(
        F.array(codes),
        lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.get(c, i) * (_A * _A) + F.get(c, i + 1) * _A + F.get(c, i + 2)
        ),
    )[0]


def log_ratios(decided: DataFrame) -> DataFrame:
    """(g, r): UNIT * log p_allow / p_block of each of the _A**3 grams; decided(url, verdict)."""
    counts = (
        decided.select((F.col("verdict") == "block").cast("int").alias("k"), F.explode(_grams(_codes(F.col("url")))).alias("g"))
        .groupBy("k", "g").agg(F.count(F.lit(1)).alias("n"))
    )
    grid = decided.sparkSession.range(2 * _A**3).select(
        (F.col("id") / _A**3).cast("int").alias("k"), (F.col("id") % _A**3).cast("int").alias("g")
    )
    d = grid.join(counts, ["k", "g"], "left").select(
        "k", "g", F.coalesce("n", F.lit(0)).alias("n"),
        F.floor(F.col("g") / _A).cast("int").alias("ab"), (F.floor(F.col("g") / _A) % _A).cast("int").alias("b"), (F.col("g") % _A).cast("int").alias("c"),
    )
    uni = d.groupBy("k", "c").agg(F.sum("n").alias("n1"))
    total = uni.groupBy("k").agg(F.sum("n1").alias("n0"))
    p1 = uni.join(total, "k").select("k", "c", ((F.col("n1") + 1) / (F.col("n0") + _A)).alias("p1"))

    def lower(counted: DataFrame, context: str, n: str, p: str, below: str) -> DataFrame:
        """Witten-Bell: weight the counts against the shorter context by the kinds that followed."""
        ctx = counted.groupBy("k", context).agg(F.sum(n).alias("s"), F.sum((F.col(n) > 0).cast("int")).alias("t"))
        mixed = (F.col(n) + F.col("t") * F.col(below)) / (F.col("s") + F.col("t"))
        return counted.join(ctx, ["k", context]).withColumn(p, F.when(F.col("s") > 0, mixed).otherwise(F.col(below))).drop("s", "t")

    two = lower(d.groupBy("k", "b", "c").agg(F.sum("n").alias("n2")).join(p1, ["k", "c"]), "b", "n2", "p2", "p1")
    three = lower(d.join(two.select("k", "b", "c", "p2"), ["k", "b", "c"]), "ab", "n", "p3", "p2")
    ratio = F.sum(F.when(F.col("k") == 0, F.log("p3")).otherwise(-F.log("p3")))
    return three.groupBy("g").agg(F.round(ratio * UNIT).cast("long").alias("r"))


def filter_urls(pages: DataFrame, key: str = "page_id", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score): score is the mean log-ratio less the calibrated cut."""
    url = F.coalesce("url", F.lit(""))
    host, path = host_path(url)
    judged = pages.select(F.col(key), url.alias("url")).select(key, "url", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select(key, "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    decided = judged.where("ruled is not null").groupBy("url").agg(F.first("ruled").alias("verdict"))
    held = F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0
    decided = stage(decided.withColumn("held", held), "decided")
    ratios = stage(log_ratios(decided.where("not held")), "ratios")
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"].cast("string"))
    listed = ratios.agg(F.array_join(numbers, ",").alias("r")).first()[0]  # _A**3 numbers, whatever the input
    table = F.from_json(F.lit(f"[{listed}]"), "array<bigint>")  # a constant, which the optimiser reads once
    grams = _grams(_codes(F.col("url")))
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a + F.get(table, g))
    mean = lambda: total / F.size(grams) / UNIT
    scored = decided.where("held").select("verdict", mean().alias("x"))
    of = lambda f, v: f(F.when(F.col("verdict") == v, F.col("x")))
    wide, narrow = of(F.stddev_pop, "allow") + 1e-6, of(F.stddev_pop, "block") + 1e-6
    # between the class means, nearer to the narrower class; null if a class is empty
    cut = scored.agg(((of(F.avg, "allow") * narrow + of(F.avg, "block") * wide) / (wide + narrow)).alias("cut")).scalar()
    out = judged.withColumn("score", mean() - cut)
    by_model = F.when(F.coalesce(F.col("score"), F.lit(0.0)) >= 0, "allow").otherwise("block")
    return out.select(key, "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
