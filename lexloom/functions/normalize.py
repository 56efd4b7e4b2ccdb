"""Text normalisation: ASCII lines as a column expression, Unicode text by an Arrow function."""

from __future__ import annotations

import codecs
import unicodedata
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.symbols import PB

SPACE, ASCII_LETTER, ASCII_DIGIT, LATIN_LETTER, LATIN_MARK, HAN, HIRAGANA, KATAKANA, HANGUL = range(1, 10)
DISALLOWED = 0
NAMES = ("Disallowed", "Space", "AsciiLetter", "AsciiDigit", "LatinLetter", "LatinMark", "Han", "Hiragana", "Katakana", "Hangul")
LETTERS = frozenset((ASCII_LETTER, LATIN_LETTER, HAN, HIRAGANA, KATAKANA, HANGUL))
CJK = frozenset((HAN, HIRAGANA, KATAKANA, HANGUL))
LATIN = frozenset((ASCII_LETTER, LATIN_LETTER, LATIN_MARK))
# ICU script numbers, and general categories of letters and marks.
_SCRIPTS = {"latin": 25, "han": 17, "hiragana": 20, "katakana": 22, "hangul": 18}
_LETTER_TYPES, _OTHER_LETTER, _MARK_TYPES = (1, 2, 3, 4, 5), 5, (6, 7, 8)
# Unicode White_Space.
WHITE = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Letters whose case folding is newer than Python's data, and ignorable letters.
_NEWER = str.maketrans({0x115F: "", 0x1160: "", 0x3164: "", 0xFFA0: "", 0xA7CB: "ɤ", 0xA7CC: "ꟍ", 0xA7DA: "ꟛ", 0xA7DC: "ƛ"})


def ascii_line(c: Column) -> Column:
    """Lower-case ASCII letters and digits; apostrophes go, anything else is one space."""
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def class_ranges(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(first, last, class) ranges of allowed code points, from the ICU data that Spark ships."""
    has = lambda s: F.reflect(F.lit("com.ibm.icu.lang.UScript"), F.lit("hasScript"), F.col("cp"), F.lit(_SCRIPTS[s])) == "true"
    points = spark.range(128, 0x110000, 1, 8).where("id NOT BETWEEN 55296 AND 57343").select(F.col("id").cast("int").alias("cp"))
    kind = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("getType"), F.col("cp")).cast("int")
    typed = points.withColumn("kind", kind).where(F.col("kind").isin(*_LETTER_TYPES, *_MARK_TYPES))
    cls = (
        F.when(F.col("kind").isin(*_MARK_TYPES), F.when(has("latin"), LATIN_MARK).otherwise(DISALLOWED))
        .when(has("latin"), LATIN_LETTER).when((F.col("kind") == _OTHER_LETTER) & has("han"), HAN)
        .when(has("hiragana"), HIRAGANA).when(has("katakana"), KATAKANA).when(has("hangul"), HANGUL).otherwise(DISALLOWED)
    )
    rows = sorted((r.cp, r.cls) for r in typed.select("cp", cls.alias("cls")).where("cls > 0").collect())  # a table of Unicode, not of the input
    out: list[list[int]] = []
    for cp, c in rows:
        if out and out[-1][1] == cp - 1 and out[-1][2] == c:
            out[-1][1] = cp
        else:
            out.append([cp, cp, c])
    return [tuple(x) for x in out]


class PatternInputError(ValueError):
    """A query literal with characters that can't be in an index."""


class Normalizer:
    def __init__(self, ranges: list[tuple[int, int, int]]):
        self.first = [r[0] for r in ranges]
        self.ranges = ranges

    def classify(self, ch: str, attached: bool = False) -> int:
        if ch == " ":
            return SPACE
        if ch < "\x80":
            return ASCII_LETTER if ch.isalpha() else ASCII_DIGIT if ch.isdigit() else DISALLOWED
        i = bisect_right(self.first, ord(ch)) - 1
        if i < 0 or ord(ch) > self.ranges[i][1]:
            return DISALLOWED
        c = self.ranges[i][2]
        return DISALLOWED if c == LATIN_MARK and not attached else c

    def fold(self, run: str) -> str:
        if run.isascii():
            return run.lower()
        nfkc = unicodedata.normalize("NFKC", run)
        return unicodedata.normalize("NFKC", nfkc.translate(_NEWER).casefold()).translate(_NEWER)

    def _folded(self, run: list[str], strict: bool) -> str:
        out, attached = [], False
        for ch in self.fold("".join(run)):
            c = self.classify(ch, attached)
            if c == DISALLOWED and strict:
                raise PatternInputError(f"disallowed query character U+{ord(ch):04X}")
            out.append(ch if c else " ")
            attached = c in LATIN
        return "".join(out)

    def spaced(self, text: str, strict: bool = False) -> str:
        """Allowed symbols with single spaces for all else; strict: an error for what isn't allowed."""
        out, run, before, attached = [], [], DISALLOWED, False
        for i, ch in enumerate(text):
            if ch in "'’" and before in LETTERS and i + 1 < len(text) and self.classify(text[i + 1]) in LETTERS:
                continue
            c = DISALLOWED if ch in WHITE else self.classify(ch, attached)
            voicing = ch in "゙゚" and before in (HIRAGANA, KATAKANA)
            if c != DISALLOWED or voicing:
                run.append(ch)
                attached = c in LATIN
                before = before if voicing else c
                continue
            if strict and ch not in WHITE:
                raise PatternInputError(f"disallowed query character U+{ord(ch):04X}")
            out += [self._folded(run, strict), " "]
            run, before, attached = [], DISALLOWED, False
        out.append(self._folded(run, strict))
        joined = "".join(out)
        while "  " in joined:
            joined = joined.replace("  ", " ")
        return joined if strict else joined.strip(" ")

    def corpus(self, text: str) -> str:
        """spaced() with position breaks around CJK symbols."""
        return self.broken(self.spaced(text))

    def typed(self, path: str) -> str:
        """A typed path as the index has it: a query literal with position breaks."""
        return self.broken(self.spaced(path, strict=True))

    def broken(self, s: str) -> str:
        if s.isascii():
            return s
        out, before, attached = [], DISALLOWED, False
        for ch in s:
            c = self.classify(ch, attached)
            if ch != " " and before and (before in CJK or c in CJK) and c != LATIN_MARK:
                out.append(PB)
            out.append(ch)
            before, attached = (DISALLOWED, False) if ch == " " else (c, c in LATIN)
        return "".join(out)


def _one_sequence(e: UnicodeError) -> tuple[str, int]:
    """A space for an undecodable sequence. Surrogates, overlong and too large forms are one sequence each."""
    raw, start, stop = e.object, e.start, e.end
    lead = raw[start]
    if lead in (0xED, 0xF4, 0xE0, 0xF0, 0xC0, 0xC1):
        size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        tail = raw[start + 1 : start + size]
        if len(tail) == size - 1 and all(0x80 <= b < 0xC0 for b in tail):
            stop = start + size
    return _BAD, stop


_BAD = "\ufdd0"  # stands for a bad sequence while decoding; valid text may have it too, so it is counted before
codecs.register_error("lexloom-sequence", _one_sequence)


def invalid_sequences(raw: bytes) -> tuple[str, int]:
    """Text with a space for each undecodable sequence, and their number."""
    text = raw.decode("utf-8", "lexloom-sequence")
    count = text.count(_BAD) - raw.count(_BAD.encode()) if _BAD in text else 0
    return text.replace(_BAD, " "), count  # a noncharacter of the text's own is a boundary too


def strict_utf8(raw: bytes) -> str:
    """The text, or a ValueError that names the byte offset."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError(f"invalid UTF-8 at byte {e.start}") from None


def ascii_corpus(c: Column) -> Column:
    """corpus() of text that is ASCII throughout, by built-in functions."""
    joined = F.regexp_replace(F.lower(c), "(?<=[a-z])'(?=[a-z])", "")
    return F.trim(F.regexp_replace(joined, "[^a-z0-9]+", " "))


def latin_tables(ranges: list[tuple[int, int, int]]) -> tuple[dict[str, str], str]:
    """Letters of Latin-1 that fold to one letter (or ss) whatever stands beside them, and a class of the symbols that are harder.

    A text without any of the class is its letters one by one: no mark joins them and no break
    divides them. Latin-1 and punctuation only, as a class of many ranges takes longer than the Normalizer.
    """
    n, easy = Normalizer(ranges), {}
    for c in map(chr, range(0x80, 0x100)):
        if n.classify(c):
            to = n.fold(c)
            if to == "ss" or (len(to) == 1 and to < "\u0100" and n.classify(to) in (ASCII_LETTER, LATIN_LETTER)):
                easy[c] = to
    hard = "".join(c for c in map(chr, range(0x80, 0x100)) if n.classify(c, True) and c not in easy)
    signs = "" if any(a <= 0x206F and b >= 0x2000 for a, b, _ in ranges) else "\u2000-\u206f"
    return easy, f"[^\\x00-\\xff{signs}]" + (f"|[{hard}]" if hard else "")


def latin_corpus(c: Column, easy: dict[str, str]) -> Column:
    """corpus() of text without the harder symbols of latin_tables(), by built-in functions."""
    letters = "a-zA-Z" + "".join(sorted(easy))
    joined = F.regexp_replace(c, f"(?<=[{letters}])['\u2019](?=[{letters}])", "")
    one = {**{chr(x): chr(x + 32) for x in range(65, 91)}, **{a: b for a, b in easy.items() if a != b and len(b) == 1}}
    folded = F.translate(joined, "".join(one), "".join(one.values()))
    for a, b in easy.items():
        if len(b) > 1:
            folded = F.replace(folded, F.lit(a), F.lit(b))
    kept = "".join(sorted({b for b in easy.values() if len(b) == 1 and b > "\x7f"}))
    return F.trim(F.regexp_replace(folded, f"[^a-z0-9{kept}]+", " "))


def corpus_text(df: DataFrame, column: str = "text") -> DataFrame:
    """df with (normalized, invalid_utf8) of a string or binary column. Rows of ASCII or Latin-1 stay in built-in functions."""
    spark = df.sparkSession
    found = class_ranges(spark)
    ranges = spark.sparkContext.broadcast(found)
    easy, hard = latin_tables(found)
    schema = T.StructType.fromDDL("normalized string, invalid_utf8 long")

    @F.pandas_udf(schema)
    def run(raws):
        import pandas as pd

        n = Normalizer(ranges.value)
        rows = [invalid_sequences(bytes(r)) if r is not None else None for r in raws]
        return pd.DataFrame([(n.corpus(r[0]), r[1]) if r else (None, 0) for r in rows], columns=schema.names)

    raw = F.col(column).cast("binary")
    text = F.try_validate_utf8(raw.cast("string"))
    plain = text.isNotNull() & (F.octet_length(text) == F.char_length(text))
    latin = text.isNotNull() & ~text.rlike(hard)
    way = F.when(raw.isNull() | plain, 0).when(latin, 1).otherwise(2)
    done = df.withColumn("_way", way).withColumn("_n", run(F.when(F.col("_way") == 2, raw)))
    normal = F.when(F.col("_way") == 0, F.coalesce(ascii_corpus(text), F.lit(""))).when(F.col("_way") == 1, latin_corpus(text, easy)).otherwise(F.col("_n.normalized"))
    return done.select(*df.columns, normal.alias("normalized"), F.col("_n.invalid_utf8").alias("invalid_utf8"))


def invalid_total(normalised: DataFrame) -> DataFrame:
    """(invalid_utf8): the undecodable sequences of all rows of corpus_text."""
    return normalised.agg(F.coalesce(F.sum("invalid_utf8"), F.lit(0)).alias("invalid_utf8"))
