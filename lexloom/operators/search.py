"""Ranked search over boundary phrases: patterns, restarts, anagrams, keypad words, filters of one's own, time limits."""

import re
import threading
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.normalize import Normalizer
from lexloom.functions.symbols import BOUNDARY, END, PB, terminator, visible
from lexloom.plans import pattern as P

RESTART = 1e-6
KEYPAD = ("abcdefghijklmnopqrstuvwxyz", "22233344455566677778889999")


def match(phrase: Column, expr: str, alphabet: frozenset[str] | None = None, normalizer: Normalizer | None = None, prefer_regex: bool = True) -> Column:
    """Whether a boundary phrase matches a pattern. Each operand of a top-level & is a predicate
    of its own; one that is regular stays a built-in regular expression, others run an automaton.
    Both take every symbol of the index for `_`, `.` and complements, or those of an alphabet.
    """
    out = None
    for tree in P.conjuncts(P.Parser(expr, normalizer).parse()):
        regex = P.to_regex(tree, alphabet) if prefer_regex else None
        if regex is not None:
            one = phrase.rlike(rf"\A(?:{regex}){BOUNDARY}\z")
        else:
            compiled = P.compile_pattern(tree, alphabet)
            one = _within(phrase, compiled, alphabet) & _accepts(compiled)(phrase)
        prefix = P.literal_prefix(tree)
        if prefix and prefix.isascii():
            one = phrase.startswith(prefix) & one  # reaches the scan; marks never stand inside quoted ASCII literals
        out = one if out is None else out & one
    return out


def _accepts(compiled: P.Compiled):
    @F.pandas_udf("boolean")
    def accepts(phrases):
        return phrases.map(compiled.accepts)

    return accepts


def _within(phrase: Column, compiled: P.Compiled, alphabet: frozenset[str] | None) -> Column:
    """A necessary condition by built-in functions: only symbols that the automaton moves on."""
    moved = {c for m in compiled.dfa.moves for c in m}
    usable = {ch for ch, c in compiled.classes.items() if c in moved}
    if P.OTHER in usable or (alphabet is not None and usable >= alphabet):
        return F.lit(True)
    return phrase.rlike(rf"\A[{''.join(map(re.escape, sorted(usable | {' ', PB, END})))}]*\z")


def ranked(found: DataFrame, limit: int | None = None, merge_boundaries: bool = False, breaks: bool = True) -> DataFrame:
    """(text, score) of found (phrase, score): the best score of each visible text.

    A text with a space after it differs from one without, unless merge_boundaries. breaks: False
    where each phrase is there once and none has a position break, so that no two have the same text.
    """
    text = visible(F.col("phrase"))
    if breaks or merge_boundaries:
        best = found.groupBy((F.rtrim(text) if merge_boundaries else text).alias("text")).agg(F.max("score").alias("score"))
    else:
        best = found.select(text.alias("text"), "score")
    return best if limit is None else best.orderBy(F.desc("score"), "text").limit(limit)


def beginning(counts: DataFrame, expr: str, alphabet: frozenset[str] | None = None, normalizer: Normalizer | None = None) -> DataFrame:
    """The rows of counts(chain, cnt) that can have a boundary phrase which matches: all rows of each such phrase.

    So their boundary phrases have their full counts where they match. Where a pattern is no
    regular expression, one that takes more stands for it.
    """
    whole, out = F.concat("chain", F.lit(END)), counts
    for tree in P.conjuncts(P.Parser(expr, normalizer).parse()):
        out = out.where(whole.rlike(rf"\A(?:{P.to_regex(tree, alphabet, wide=True)}){BOUNDARY}"))
    return out


def find(phrases: DataFrame, expr: str, limit: int | None = None, alphabet: frozenset[str] | None = None, normalizer: Normalizer | None = None, merge_boundaries: bool = False, prefer_regex: bool = True, breaks: bool = True) -> DataFrame:
    """(text, score) of phrases(phrase, cnt) that match, without combinations."""
    hits = phrases.where(match(F.col("phrase"), expr, alphabet, normalizer, prefer_regex))
    return ranked(hits.select("phrase", F.col("cnt").cast("double").alias("score")), limit, merge_boundaries, breaks)


def _positive(name: str, value: int | None) -> None:
    if value is not None and (not isinstance(value, int) or isinstance(value, bool) or value < 1):
        raise ValueError(f"{name} must be a positive integer")


def find_combined(
    phrases: DataFrame, expr: str, total: int, segments: int | None = None, limit: int | None = None, restart: float = RESTART, alphabet: frozenset[str] | None = None, normalizer: Normalizer | None = None, stage=None
) -> DataFrame:
    """(text, score) of phrases in a row; all but the last end at a space.

    Joining costs cnt / total * restart. A phrase that already completes the pattern isn't
    extended. With a limit, each automaton state keeps as many best beginnings in each round,
    which can't lose a result, as what follows depends on the state alone. Any number of phrases
    may follow one another unless `segments` says less: a pattern of bounded length ends by
    itself, and with a limit the search ends once no longer row can come among the best; an
    endless pattern without either is an error. `stage` may write each round, or each computes
    those before it again.
    """
    keep = stage or (lambda df, name: df)
    _positive("segments", segments)
    _positive("limit", limit)
    compiled = P.compile_pattern(P.Parser(expr, normalizer).parse(), alphabet)
    if segments is None:
        segments = compiled.dfa.longest(frozenset(compiled.classes[c] for c in (" ", PB, END)))  # each phrase has a symbol at least
        if segments is None and limit is None and restart:
            raise ValueError("an endless pattern needs a limit or a number of segments")
    accepting = sorted(compiled.dfa.accepting)
    phrases = phrases.where(_within(F.col("phrase"), compiled, alphabet))

    def steps(states: list[int]):
        @F.pandas_udf("array<struct<a:int,b:int>>")
        def live(texts):
            return texts.map(lambda t: [{"a": s, "b": e} for s in states if (e := compiled.state(t, s)) >= 0])

        return phrases.select("phrase", "cnt", F.explode(live(F.col("phrase"))).alias("step")).select("phrase", "cnt", "step.*")

    now = keep(steps([0]).select("phrase", F.lit(1.0).alias("scale"), "cnt", "b"), "segments")
    found, turn = None, 0
    most = phrases.agg(F.max("cnt")).first()[0] or 0 if segments is None else 0
    while True:
        hits = now.where(F.col("b").isin(accepting)).select("phrase", (F.col("scale") * F.col("cnt")).alias("score"))
        found = hits if found is None else found.unionByName(hits)
        turn += 1
        if turn == segments or restart == 0:
            break
        ends = now.where(~F.col("b").isin(accepting) & F.col("phrase").endswith(" "))
        joined = ends.select("b", visible(F.col("phrase")).alias("begun"), (F.col("scale") * (F.col("cnt") / F.lit(total)) * F.lit(restart)).alias("scale"))
        joined = joined.groupBy("b", "begun").agg(F.max("scale").alias("scale"))
        if limit is not None:
            rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("scale"), "begun"))
            joined = joined.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
        heads = joined.groupBy("b").agg(F.max("scale").alias("scale")).collect()  # a row for each state of one automaton
        if not heads:
            break
        if segments is None:
            worst = ranked(found, limit).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            if worst.n == limit and worst.least > max(h.scale for h in heads) * most:
                break
        after = steps([h.b for h in heads])
        now = keep(joined.join(after, joined.b == after.a).select(F.concat("begun", "phrase").alias("phrase"), "scale", "cnt", after.b), "segments")
    return ranked(found, limit)


def find_filtered(phrases: DataFrame, make_filter, limit: int | None = None, merge_boundaries: bool = False) -> DataFrame:
    """(text, score) of the phrases that a filter of one's own lets through.

    make_filter() runs once in each Python worker that needs it and returns a function from a
    visible text and its boundary (`space`, `pb` or `end`) to a truth value.
    """
    _positive("limit", limit)

    @F.pandas_udf("boolean")
    def passes(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        keep = make_filter()
        for said, ends in texts:
            yield pd.Series([bool(keep(t, e)) for t, e in zip(said, ends)], dtype="bool")

    text = F.regexp_replace(F.col("phrase"), f"{BOUNDARY}$", "")
    hits = phrases.where(passes(text, terminator(F.col("phrase"))))
    return ranked(hits.select("phrase", F.col("cnt").cast("double").alias("score")), limit, merge_boundaries)


def capped(df: DataFrame, seconds: float = 30, action=lambda df: df.collect()):
    """The result of an action on df, or a TimeoutError after some seconds; its jobs are cancelled then."""
    if not seconds > 0:
        raise ValueError("seconds must be positive")
    context, group, late = df.sparkSession.sparkContext, f"capped-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    context.setJobGroup(group, "capped", interruptOnCancel=True)
    timer.start()
    try:
        return action(df)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def _words(phrases: DataFrame) -> DataFrame:
    """(phrase, cnt, word): phrases of one unbroken word that end at a space or the end."""
    word = F.regexp_replace("phrase", f"[ {PB}{END}]", "")
    return phrases.where(F.col("phrase").rlike(rf"\A[^ {END}]+[ {END}]\z") & ~F.col("phrase").endswith(PB)).withColumn("word", word)


def find_anagrams(phrases: DataFrame, letters: str) -> DataFrame:
    """(text, score) of the words that use exactly these letters."""
    if not letters or any(c in f" {PB}{END}" for c in letters):
        raise ValueError("letters must be visible symbols")
    hits = _words(phrases).where(F.char_length("word") == len(letters)).where(F.array_sort(F.split("word", "")) == F.array(*map(F.lit, sorted(letters))))
    return ranked(hits.select("phrase", F.col("cnt").cast("double").alias("score")))


def find_phone_words(phrases: DataFrame, digits: str) -> DataFrame:
    """(text, score) of the words whose letters lie on these keys."""
    if not all(c in "0123456789" for c in digits):
        raise ValueError("digits only")
    hits = _words(phrases).where(F.translate("word", *KEYPAD) == digits)
    return ranked(hits.select("phrase", F.col("cnt").cast("double").alias("score")))
