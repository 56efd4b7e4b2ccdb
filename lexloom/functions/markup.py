"""Wiki-markup removal, redirects, markers, Chinese conversion and display size."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that go with all they hold, and the schemes of outside links.
WHOLE = ("ref", "gallery", "imagemap")
SCHEMES = ("http://", "https://", "ftp://")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile(r"\{+")
_SIGN = re.compile(r"[<&{\[\]]")  # without one of these no kind of markup changes a text
_MARKER = re.compile("(?i)(?=(?:BEGIN|END) ARTICLE)")


def _name_at(s: str, at: int) -> tuple[str, int]:
    """The tag name (a letter, then letters and digits) that starts at `at`, and where it ends."""
    end = at
    while end < len(s) and s[end].isascii() and s[end].isalnum() and not (end == at and s[end].isdigit()):
        end += 1
    return s[at:end].lower(), end


def _tag_end(s: str, name_end: int) -> int:
    """Where the tag ends whose name ends at `name_end`; -1 if it isn't a tag."""
    if s[name_end : name_end + 1] not in (" ", "/", ">"):
        return -1
    stop = s.find(">", name_end)
    if stop < 0 or (s[name_end] == "/" and stop != name_end + 1):
        return -1
    return stop + 1


def drop_elements(s: str) -> str:
    """Comments, and the elements of WHOLE with their content, taken out."""
    if "<" not in s:
        return s
    out, at, low = [], 0, s.lower()
    while (start := s.find("<", at)) >= 0:
        end = -1
        if s.startswith("<!--", start):
            end = s.find("-->", start + 4)
            end = end + 3 if end >= 0 else -1
        else:
            name, stop = _name_at(s, start + 1)
            head = _tag_end(s, stop) if name in WHOLE else -1
            if head >= 0 and s[head - 2] != "/":
                end = low.find(f"</{name}>", head)
                end = end + len(name) + 3 if end >= 0 else -1
        out.append(s[at : start if end >= 0 else start + 1])
        at = end if end >= 0 else start + 1
    return "".join(out) + s[at:]


def drop_braces(s: str) -> str:
    """Templates and tables taken out, whatever their nesting; a sign without its partner stays."""
    if "{" not in s:
        return s  # nothing is opened, so every sign stays
    out: list[str] = []
    opened: list[tuple[str, int]] = []  # (closing sign, length of out before the opening one)
    at = 0
    for m in re.finditer(r"[{}|]", s):
        i = m.start()
        if i < at:
            continue
        two = s[i : i + 2]
        if two == "{{" and len(_RUN.match(s, i)[0]) % 2:
            continue  # of an odd number of braces the last ones belong together
        if two in ("{{", "{|"):
            out.append(s[at:i])
            opened.append(("}}" if two == "{{" else "|}", len(out)))
            out.append(two)
            at = i + 2
        elif two in ("}}", "|}") and any(sign == two for sign, _ in opened):
            while opened[-1][0] != two:
                opened.pop()
            del out[opened.pop()[1] :]
            at = i + 2
    return "".join(out) + s[at:]


def spaced_tags(s: str) -> str:
    """A space for each tag and each named entity."""
    if "<" not in s and "&" not in s:
        return s
    out, at = [], 0
    for m in re.finditer("[<&]", s):
        i = m.start()
        if i < at:
            continue
        if s[i] == "<":
            name, stop = _name_at(s, i + 2 if s.startswith("</", i) else i + 1)
            end = _tag_end(s, stop) if name else -1
        else:
            end = i + 1
            while end < len(s) and s[end].lower() in _LETTERS:
                end += 1
            end = end + 1 if end > i + 1 and s[end : end + 1] == ";" else -1
        if end >= 0:
            out += [s[at:i], " "]
            at = end
    return "".join(out) + s[at:]


def _is_named(content: str) -> bool:
    """Whether a link is into a namespace: letters and hyphens, then a colon."""
    head, colon, _ = content.partition(":")
    return bool(colon) and all(c in _LETTERS or c == "-" for c in head.lower())


def labelled_links(s: str) -> str:
    """Links replaced by their labels; links into a namespace go."""
    if "[" not in s and "]" not in s:
        return s
    out: list[str] = []
    opened: list[int] = []
    at = 0
    for m in re.finditer(r"[\[\]]", s):
        i = m.start()
        if i < at:
            continue
        two = s[i : i + 2]
        if two == "[[":
            out.append(s[at:i])
            opened.append(len(out))
            out.append(two)
            at = i + 2
        elif two == "]]" and opened:
            out.append(s[at:i])
            first = opened.pop()
            content = "".join(out[first + 1 :])
            del out[first:]
            parts = content.split("|")
            out.append("" if _is_named(content) else parts[min(1, len(parts) - 1)])
            at = i + 2
        elif s.startswith(SCHEMES, i + 1) or s[i + 1 : i + 9].lower().startswith(SCHEMES):
            end = s.find("]", i)
            if s[i] == "[" and end >= 0:
                _, space, label = s[i + 1 : end].partition(" ")
                out += [s[at:i], space + label]
                at = end + 1
    return "".join(out) + s[at:]


def strip_markup(text: str | None) -> str:
    """All kinds of markup taken out, again until nothing changes; then article markers are escaped."""
    s, before = text or "", None
    while s != before and _SIGN.search(s):
        before = s
        s = labelled_links(spaced_tags(drop_braces(drop_elements(s))))
    if "article" in s.lower() or "\u0131" in s or "\u0130" in s:  # the two letters that (?i) takes for an I as well
        s = _MARKER.sub(">", s)
    return s


def plain_text(df: DataFrame, column: str) -> DataFrame:
    """df with `plain`: the column without markup (nested, hence an Arrow function)."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(strip_markup)

    return df.withColumn("plain", run(F.col(column)))


def strip_tags(html: Column) -> Column:
    """Comments, scripts and styles removed, tags and references to spaces: built-in functions only."""
    for opening, closing in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>")):
        html = F.regexp_replace(html, f"(?is){opening}.*?{closing}", "")
    s = F.regexp_replace(html, "<[A-Za-z/!][^>]*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "&#?[A-Za-z0-9]+;", " "), "[ \\t\\r\\n]+", " "))


def articles(pages: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Pages that have a title and a text and are no redirect."""
    return pages.where(f"{title} <> '' AND {text} <> ''").where(~F.col(text).rlike("(?i)^#REDIRECT"))


def display_size(score: Column) -> Column:
    size = F.when(score >= 1, 1.5 + F.ln(score) / 5).when(score > 0, 1.5 + F.ln(score) / 50).otherwise(0.0)
    return F.greatest(size, F.lit(0.4))


def convert_characters(text: Column, characters: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Phrases (longest first), then single characters, replaced by a supplied table."""
    single = F.translate(text, "".join(characters), "".join(characters.values()))
    if not phrases:
        return single
    table, by = {**characters, **phrases}, re.compile("|".join(map(re.escape, sorted({**characters, **phrases}, key=len, reverse=True))))

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: t and by.sub(lambda m: table[m[0]], t))

    return run(text)


def file_status(spark, source: str, target: str, first: int | None = None) -> DataFrame:
    """(name, status, text) of the files under `source`, named by their path below it.

    status: converted (to be, with text), skipped (target has it), failed (no valid UTF-8), or
    left (behind the `first` names).
    """
    root = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*|^/+", "", source).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    name = F.regexp_replace("path", rf"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/|\Q{root[1:]}\E)", "")
    name = F.regexp_replace(name, rf"^/?\Q{root[1:]}\E", "")
    found = files.select(name.alias("name"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    if first is not None:
        chosen = found.select("name").orderBy("name").limit(first).withColumn("chosen", F.lit(True))
        found = found.join(chosen, "name", "left")
    else:
        found = found.withColumn("chosen", F.lit(True))
    try:
        done = spark.read.parquet(target).select("name").distinct().withColumn("done", F.lit(True))
        found = found.join(done, "name", "left")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = found.withColumn("done", F.lit(None).cast("boolean"))
    status = F.when(F.col("chosen").isNull(), "left").when(F.col("done"), "skipped").when(F.col("text").isNull(), "failed").otherwise("converted")
    return found.select("name", status.alias("status"), "text")


def convert_files(spark, source: str, target: str, characters: dict[str, str], first: int | None = None, dry_run: bool = False) -> dict[str, int]:
    """Convert the text files under `source` that `target` doesn't have yet; the summary counts."""
    status = file_status(spark, source, target, first)
    n = {r.status: r.n for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most
    if not dry_run:
        made = status.where("status = 'converted'").select("name", convert_characters(F.col("text"), characters).alias("text"))
        made.write.mode("append").parquet(target)
    counts = {k: n.get(k, 0) for k in ("converted", "skipped", "failed")}
    return {"scanned": sum(n.values()), "selected": sum(counts.values()), **counts}
