"""Normalisation, chains, index, merge, patterns, search, ranking, sources and builds."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexloom.functions import markup, normalize
from lexloom.functions.symbols import END, PB
from lexloom.operators import index, rank, search
from lexloom.plans import automaton, build, queries
from lexloom.plans import pattern as P
from lexloom.sources import corpus
from lexloom.streaming.rank import index_stream, rank_stream


@pytest.fixture(scope="module")
def normalizer(spark):
    return normalize.Normalizer(normalize.class_ranges(spark))


def weighted(spark, rows):
    return spark.createDataFrame(rows, "chain string, cnt long")


RANKING = [("cat", 100), ("cat dog", 80), ("catfish", 5), ("dog", 170)]


@pytest.fixture(scope="module")
def ranking(spark):
    return index.boundary_phrases(weighted(spark, RANKING))


# --- normalisation


def test_classification(normalizer):
    want = {"a": "AsciiLetter", "7": "AsciiDigit", "é": "LatinLetter", "中": "Han", "か": "Hiragana", "カ": "Katakana", "한": "Hangul", "α": "Disallowed", "①": "Disallowed", "\U0001d400": "Disallowed"}
    assert {c: normalize.NAMES[normalizer.classify(c)] for c in want} == want
    assert normalizer.classify("́", True) == normalize.LATIN_MARK and normalizer.classify("́") == 0


def test_corpus_normalisation(normalizer):
    n = normalizer.corpus
    assert n("ＡＩ时代") == f"ai{PB}时{PB}代"
    assert n("中国科学院") == PB.join("中国科学院")
    assert n("I'm") == "im" and n("rock 'n' roll") == "rock n roll"
    assert n("café") == n("café") == "café"
    assert n("  a---b  ") == "a b" and n("台") != n("臺")
    assert n("が") == "が" and n("ﬁx") == "fix"
    assert n("α") == "" and n("Straße") == "strasse"


def test_query_literals(normalizer):
    with pytest.raises(normalize.PatternInputError, match="U\\+03B1"):
        normalizer.spaced("α", strict=True)
    assert normalizer.spaced(" ß ", strict=True) == " ss "


def test_utf8():
    assert normalize.invalid_sequences(b"a\x80\x80b") == ("a  b", 2)
    assert normalize.invalid_sequences(b"x\xed\xa0\x80y") == ("x y", 1)
    for raw in (b"\x80", b"\xe4\xb8", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        with pytest.raises(ValueError, match="byte 0"):
            normalize.strict_utf8(raw)


def test_corpus_text_frame(spark):
    df = spark.createDataFrame([(1, b"a\x80\x80b"), (2, None), (3, "Open源 中国".encode())], "id int, text binary")
    got = {r.id: (r.normalized, r.invalid_utf8) for r in normalize.corpus_text(df).collect()}
    assert got == {1: ("a b", 2), 2: ("", 0), 3: (f"open{PB}源 中{PB}国", 0)}


def test_ascii_line(spark):
    cases = {"  I'M--A\tTeST! ☃  ": "im a test", "'''!!!": "", "é a": "a", "A1-b2": "a1 b2"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", normalize.ascii_line(F.col("x")).alias("y")).collect()} == cases


# --- chains and index


def chains_by_hand(text, cap):
    out, starts, run = [], [], 0
    for i, c in enumerate(text):
        if c in " " + PB:
            run = 0
            continue
        if run % cap == 0:
            starts.append(i)
        run += 1
    for s in starts:
        seen, chain = 0, ""
        for c in text[s:]:
            if c not in " " + PB:
                if seen == cap:
                    break
                seen += 1
            chain += c
        out.append(chain.rstrip(" " + PB))
    return out


def test_chains(spark):
    rng = random.Random(1)
    cases = [(f"ab 中{PB}国", 40), ("a" * 41, 40), ("the cat sat", 7), ("", 40), ("x", 40)]
    for _ in range(40):
        cases.append((" ".join("".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(rng.randint(1, 9))), rng.choice([3, 7, 40])))
    for cap in {c for _, c in cases}:
        mine = [t for t, c in cases if c == cap]
        got = spark.createDataFrame([(i, t) for i, t in enumerate(mine)], "i int, t string").select("i", index.chains(F.col("t"), cap).alias("c")).orderBy("i").collect()
        assert [r.c for r in got] == [chains_by_hand(t, cap) for t in mine]
    assert chains_by_hand("the cat sat", 7) == ["the cat s", "cat sat", "sat"]


def test_index_tables(spark, tmp_path):
    lines = spark.createDataFrame([("a b", 10), ("a b", 1), ("a c", 1)], "text string, weight int")
    counts = index.chain_counts(lines, weight="weight")
    assert {tuple(r) for r in counts.collect()} == {("a b", 11), ("b", 11), ("a c", 1), ("c", 1)}
    assert {tuple(r) for r in index.with_text(index.boundary_phrases(counts)).collect()} == {("a", "space", 12), ("a b", "end", 11), ("a c", "end", 1), ("b", "end", 11), ("c", "end", 1)}
    assert {r[0] for r in index.alphabet(counts).collect()} == {"a", "b", "c", " "} and index.total(counts).first()[0] == 24
    assert {tuple(r) for r in index.children(counts, "a ").collect()} == {("b", 11), ("c", 1)}
    ranks = {r.prefix: r.sibling_rank for r in index.prefix_counts(counts, 3).collect()}
    assert ranks["a b"] == 1 and ranks["a c"] == 2 and ranks["a"] == 1
    path = str(tmp_path / "one")
    index.save(counts, path)
    assert {tuple(r) for r in index.load(spark, path).collect()} == {tuple(r) for r in counts.collect()}
    with pytest.raises(Exception, match="exists"):
        index.save(counts, path)
    index.save(counts, str(tmp_path / "other"), {**index.METADATA, "unicode_version": "1"})
    with pytest.raises(ValueError, match="metadata"):
        index.merge_saved(spark, [path, str(tmp_path / "other")])
    assert index.total(index.merge_saved(spark, [path, path])).first()[0] == 48
    assert {r.chain for r in index.dump(weighted(spark, [(f"中{PB}国", 1)])).collect()} == {"中<PB>国<END>"}


def cut_by_hand(rows, least):
    """Deepest prefix first over a dictionary."""
    own, emitted, out = Counter(), set(), Counter()
    for chain, n in rows:
        own[chain + END] += n
    depth = lambda p: sum(c in f" {PB}{END}" for c in p)
    below = set()
    for d in range(max(map(depth, own)), 0, -1):
        for p in [x for x in own if depth(x) == d]:
            cut = max((i + 1 for i, c in enumerate(p[:-1]) if c in " " + PB), default=0)
            if own[p] >= least or (own[p] > 0 and p in below):
                out[p.removesuffix(END)] += own[p]
                emitted.add(p)
            elif cut:
                own[p[:cut]] += own[p]
            if cut and (p in emitted or p in below):
                own[p[:cut]] += 0
                below.add(p[:cut])
    return dict(out)


def test_cutoff(spark):
    assert {tuple(r) for r in index.cut_off(weighted(spark, [("a b", 1), ("a c", 1)]), 2).collect()} == {("a ", 2)}
    assert {tuple(r) for r in index.cut_off(weighted(spark, [("a b", 3), ("a c", 1)]), 2).collect()} == {("a b", 3), ("a ", 1)}
    rng = random.Random(5)
    for _ in range(4):
        rows = Counter()
        for _ in range(25):
            rows["".join(rng.choice("ab") + rng.choice([" ", PB, ""]) for _ in range(rng.randint(1, 5))).rstrip(" " + PB)] += rng.randint(1, 3)
        assert dict(map(tuple, index.cut_off(weighted(spark, list(rows.items())), 4).collect())) == cut_by_hand(rows.items(), 4)
    assert index.cut_off(weighted(spark, []), 2).count() == 0


def test_cutoff_of_whole_chains(spark, tmp_path):
    """Prefixes of more than three words are kept, and roll up from there."""
    lines = ["one two three four five six"] * 5 + ["one two three four other"] * 3 + ["one two three four last"] * 2 + ["a b c d e"] * 4
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, queries.QUERIES["merge_cutoff"](spark, str(tmp_path)).collect()))
    chains = [(c, 1) for t in lines for c in chains_by_hand(t, 40)]
    assert got == cut_by_hand(chains, 5) and got["one two three four five six"] == 5 and got["one two three four "] == 5


def test_merge_of_all_languages(spark, tmp_path):
    rows = [(i, "ab cd", x, "s", 5) for i, x in enumerate(["en", "de", "fr", "es", "it", "", None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(map(tuple, queries.QUERIES["merge_sources"](spark, str(tmp_path)).collect())) == {"ab cd": 7, "cd": 7}



# --- patterns

# Patterns with a phrase that each takes and one that it doesn't.
GOLDEN = [
    ('"(((((m?o)?c)?h)?i)t?)_(h(a(t(o(ry?)?)?)?)?)?&_{5,}" ', "chitchat", "itch"),
    ('("<(-may)?(-sit)?(tit)?(ble)?(com)?(iks)?(ial)?(im-b)?(-mon)?>"&_{18}) ', "mayim bialiks sitcom", "mayim bialiks common"),
    ("([aehimnprsw]*&_*a_*&_*e_*&_*h_*&_*i_*&_*m_*&_*n_*&_*p_*&_*r_*&_*s_*&_*w_*) ", "new hampshire", "minesweeper ship"),
    ("<eelqsuuu> ", "equuleus", "equus"),
    ("(c?h?a?r?m?&____)(e?l?t?o?n?&____)(c?h?e?s?t?&____)(o?n?e?&__) ", "charlton heston", "charmton heston"),
    ("(<(cerb)?(ecto)?(lonm)?(ddog)?(fblo)?(iero)?(skey)?(ells)?(dwhi)?(atra)?(subj)?(odan)?(thel)?>&_{24}) ", "subject of blood and whiskey", "subject of blood and whisubj"),
    ("<het><ral><seg><tan><rut><bla><oody><afl><ndi><cin><awe><ter> ", "the largest natural body of land in ice water", "the largest natural body of water in iceland"),
    ('"<(cs)(dy)(er)(i)(mo)(n)(th)(__?)>" ', "thermodynamics", "thermodyanmics"),
    ("(<waterhegm>&_*w_*a_*t_*e_*r_*) ", "wheat germ", "merge what"),
]


@pytest.mark.parametrize("expr,yes,no", GOLDEN)
def test_golden_patterns(expr, yes, no):
    c = P.compile_pattern(P.Parser(expr).parse(), boundary=False)
    assert c.accepts(yes + " ") and not c.accepts(no + " ")


def test_empty_intersection():
    c = P.compile_pattern(P.Parser("foo&bar").parse())
    assert not c.dfa.accepting


SYNTAX = ["(a", "[a", "a{", "a{2,1}", "a{256}", "a{,3}", "<>", "[]", "[b-a]", "[a-]", "*", "a)", '"a', "'", "a**", "[é-z]", "a{1", "<a"]


@pytest.mark.parametrize("expr", SYNTAX)
def test_syntax_errors(expr, normalizer):
    with pytest.raises(P.PatternSyntaxError):
        P.Parser(expr, normalizer).parse()
    P.Parser("a{256,}").parse()


def test_unicode_patterns(normalizer):
    def accepts(expr, corpus_line):
        text = normalizer.corpus(corpus_line)
        c = P.compile_pattern(P.Parser(expr, normalizer).parse(), frozenset(text) - {PB})
        return c.accepts(text + END)

    assert accepts("中国", "中国") and accepts("[中英]文", "中文") and accepts("ß{2}", "ssss") and accepts("B", "b")
    with pytest.raises(P.PatternSyntaxError, match="non-ASCII"):
        P.Parser("[一-龥]", normalizer).parse()
    with pytest.raises(P.PatternSyntaxError, match="byte 0.*U\\+03B1"):
        P.Parser("α", normalizer).parse()


def test_limits(monkeypatch):
    monkeypatch.setattr(automaton, "MAX_STATES", 50)
    with pytest.raises(automaton.LimitError):
        P.compile_pattern(P.Parser("(a{200})").parse())


def random_pattern(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["a", "b", "_", ".", "-", "[ab]", "[^a]", " ", "V"])
    x, y = random_pattern(rng, depth - 1), random_pattern(rng, depth - 1)
    return rng.choice([x + y, f"({x}|{y})", f"({x})*", f"({x}){{0,2}}", f'"{x}{y}"' if '"' not in x + y else x, f"({x}&{y})", f"<({x})({y})>"])


def test_regex_and_automaton_agree(spark):
    rng = random.Random(11)
    texts = sorted({"".join(rng.choices("ab e", k=rng.randint(0, 5))).strip() + rng.choice([" ", END, PB]) for _ in range(250)})
    df = spark.createDataFrame([(t,) for t in texts], "phrase string")
    exprs = [e for e in {random_pattern(rng) for _ in range(60)} if '""' not in e][:40]
    regular = [e for e in exprs if P.to_regex(P.Parser(e).parse()) is not None]
    assert len(regular) > 10
    alphabet = frozenset("abe ")
    row = df.select("phrase", *[search.match(F.col("phrase"), e, alphabet).alias(f"c{i}") for i, e in enumerate(regular)]).collect()
    for i, e in enumerate(regular):
        c = P.compile_pattern(P.Parser(e).parse(), alphabet)
        assert [r[f"c{i}"] for r in row] == [c.accepts(r.phrase) for r in row], e


# --- search


def test_search_keeps_boundaries_apart(ranking):
    rows = lambda df: {r.text: r.score for r in df.collect()}
    assert rows(search.find(ranking, "cat")) == {"cat": 100.0, "cat ": 80.0}
    assert rows(search.find(ranking, "cat", merge_boundaries=True)) == {"cat": 100.0}
    assert rows(search.find(ranking, "cat_*", prefer_regex=False)) == rows(search.find(ranking, "cat_*"))
    assert rows(search.find(ranking, "zebra")) == {}


def test_restart(spark, ranking):
    rows = {r.text: r.score for r in search.find_combined(ranking, "catcat", 355).collect()}
    assert rows == {"cat cat": pytest.approx(80 / 355 * 1e-6 * 100), "cat cat ": pytest.approx(80 / 355 * 1e-6 * 80)}
    assert search.find_combined(ranking, "dogcat", 355).count() == 0  # dog is never before a space
    assert search.find_combined(ranking, "a*b*", 10, restart=0).count() == 0
    three = search.find_combined(ranking, '"cat cat cat"', 355, segments=3, limit=1).collect()
    assert [r.text for r in three] == ["cat cat cat"]
    many = index.boundary_phrases(weighted(spark, [("a x", 5), ("b", 7), ("ab", 2)]))
    assert [r.text for r in search.find_combined(many, "ab", 20).orderBy(F.desc("score")).collect()] == ["ab", "a b"]


def test_words(spark):
    phrases = index.boundary_phrases(weighted(spark, [("the cat", 3), ("teh", 2), ("t he", 9), (f"t{PB}中", 1), ("het", 1)]))
    assert {tuple(r) for r in search.find_anagrams(phrases, "eht").collect()} == {("the ", 3.0), ("teh", 2.0), ("het", 1.0)}
    assert {tuple(r) for r in search.find_phone_words(phrases, "843").collect()} == {("the ", 3.0)}
    assert search.find_phone_words(phrases, "").count() == 0
    for bad in ("", "a b"):
        with pytest.raises(ValueError):
            search.find_anagrams(phrases, bad)
    with pytest.raises(ValueError):
        search.find_phone_words(phrases, "8x")


def test_paging_and_size(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", 0.5)], "text string, score double")
    assert [r.text for r in corpus.page(df, 1, 2).collect()] == ["b", "c"]
    sizes = [r[0] for r in df.select(markup.display_size(F.col("score"))).collect()]
    assert sizes[2] == 1.5 and sizes[3] == pytest.approx(1.4861, abs=1e-4)
    assert spark.range(1).select(markup.display_size(F.lit(0.0))).first()[0] == 0.4
    assert {r[0] for r in corpus.result_lines(spark.createDataFrame([("cat ", 80.0), ("x", 1.5e-7)], "text string, score double")).collect()} == {"80 cat", "1.5e-07 x"}


# --- ranking

LINES = {"cat": (100, "cat"), "catdog": (80, "cat dog"), "cat dog": (80, "cat dog"), "catfish": (5, "catfish"), "zebra": (0, "zebra"), "!!!": (0, ""), "dogcat": (0, "dogcat")}


def test_rank_lines(spark, ranking):
    df = spark.createDataFrame(list(enumerate(LINES)), "line_number long, line string")
    got = {r.line_number: (r.score, r.text) for r in rank.rank_lines(df, ranking, 355).collect()}
    assert got == {i: (pytest.approx(s), t) for i, (s, t) in enumerate(LINES.values())}
    order = ["catfish", "catdog", "missing", "cat", "catfish"]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(order)], "line_number long, line string")
    assert [r.line_number for r in rank.rank_lines(df, ranking, 355).collect()] == [4, 2, 1, 5, 3]
    few = {r.line_number: (r.score, r.text) for r in rank.rank_lines(df, ranking, 355, max_steps=1).collect()}
    assert few[2] == (-1.0, "catdog")
    assert rank.rank_lines(spark.createDataFrame([(1, None)], df.schema), ranking, 355).first().score == 0
    own = rank.rank_with(df, lambda line: (len(line), line)).collect()
    assert {(r.line_number, r.score) for r in own} == {(i + 1, float(len(x))) for i, x in enumerate(order)}


def test_rank_agrees_with_search(spark, ranking):
    for line in ("catcat", "cat catdog", "catcatcat"):
        df = spark.createDataFrame([(1, line)], "line_number long, line string")
        found = search.find_combined(ranking, line, 355, segments=3, limit=5).orderBy(F.desc("score"), "text").first()
        got = rank.rank_lines(df, ranking, 355).first()
        assert (got.score, got.text) == (pytest.approx(found.score), found.text.strip())


def test_streams(spark, ranking, tmp_path):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_number long, line string")
    lines.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    rank_stream(stream, ranking, 355, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = {r.line_number: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: pytest.approx(s) for i, (s, _) in enumerate(LINES.values())}
    index_stream(stream.withColumnRenamed("line", "text"), str(tmp_path / "runs"), str(tmp_path / "c2")).awaitTermination()
    runs = spark.read.parquet(str(tmp_path / "runs")).select("chain", "cnt")
    assert dict(map(tuple, index.merge(runs).collect()))["cat"] == 1


# --- sources and builds


def test_marked_lines(spark):
    lines = ["BEGIN ARTICLE: T one", "body", "END ARTICLE: T one", '<doc id="1">', "Two", "text", "</doc>"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    assert sorted(map(tuple, corpus.marked_lines(df.withColumn("file", F.lit(1)), "file").collect())) == sorted([(" T one", 10), ("body", 1), ("Two", 10), ("text", 1)])


def test_markup():
    s = markup.strip_markup
    assert s("a <!-- x --> [[File:x|y]] {{t|{{u}}}} [[link|label]] [[plain]] [http://x.y text] &nbsp; <b>z</b>").split() == ["a", "label", "plain", "text", "z"]
    assert s("{| table |} x BEGIN ARTICLE").split() == ["x", ">BEGIN", "ARTICLE"] and s(None) == ""


def test_conversion(spark, tmp_path):
    table = {"數": "数", "學": "学", "體": "体", "與": "与", "結": "结", "構": "构"}
    df = spark.createDataFrame([("數學",), ("繁體中文與结构\r\n<b>",)], "t string")
    assert [r[0] for r in df.select(markup.convert_characters(F.col("t"), table)).collect()] == ["数学", "繁体中文与结构\r\n<b>"]
    assert [r[0] for r in df.select(markup.convert_characters(F.col("t"), table, {"數學": "Math"})).collect()][0] == "Math"
    source = tmp_path / "in"
    source.mkdir()
    for i in range(7):
        (source / f"f{i}.txt").write_text("數", encoding="utf-8")
    (source / "f1.txt").write_bytes(b"\xff")
    args = (spark, str(source), str(tmp_path / "out"), table)
    assert markup.convert_files(*args, first=1)["converted"] == 1
    assert markup.convert_files(*args, first=5) == {"scanned": 7, "selected": 5, "converted": 3, "skipped": 1, "failed": 1}
    assert markup.convert_files(*args, dry_run=True)["converted"] == 2


def test_build(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<x><page><title>Open源</title><revision><text>'''Open''' the cat [[sat|sits]]\nthe cat</text></revision></page>"
        "<page><title>R</title><revision><text>#redirect [[Y]]</text></revision></page></x>", encoding="utf-8",
    )
    b = build.Build(str(tmp_path / "root"), {"one": str(tmp_path / "a.xml")}, cutoff=2, test="the_*")
    assert {tuple(r) for r in b.run(spark).collect()} == {("the ", 2.0)}  # "the cat" twice, but at two boundaries
    again = build.Build(b.root, b.dumps, cutoff=2)
    again.run(spark)
    assert all("exists" in x for x in again.log)
    dry = build.Build(str(tmp_path / "none"), b.dumps, dry_run=True)
    assert dry.run(spark) is None and all("would" in x for x in dry.log)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_class_with_every_symbol(spark):
    """`_` and `.` in a class are members beside the others."""
    df = spark.createDataFrame([(f"a{c}b{END}",) for c in ("", " ", "x", "é")], "phrase string")
    for expr, want in {'"a[_ ]b"': {" ", "x", "é"}, '"a[^_]b"': {" "}, '"a[^_ ]b"': set(), '"a[^.]b"': set(), '"a[.]b"': {" ", "x", "é"}, '"a_b"': {"x", "é"}}.items():
        for regex in (True, False):
            got = {r.phrase[1:-2] for r in df.where(search.match(F.col("phrase"), expr, prefer_regex=regex)).collect()}
            assert got == want, (expr, regex)
    with pytest.raises(P.PatternSyntaxError):
        P.Parser("[_(]").parse()
    ascii_only = {r.phrase[1:-2] for r in df.where(search.match(F.col("phrase"), '"a_b"', P.ASCII)).collect()}
    assert ascii_only == {"x"}


def test_restart_without_bound(spark):
    phrases = index.boundary_phrases(weighted(spark, [("a x", 5), ("b x", 7), ("c", 2)]))
    got = {r.text for r in search.find_combined(phrases, "abac", 20).collect()}
    assert got == {"a b a c"}
    with pytest.raises(ValueError, match="endless"):
        search.find_combined(phrases, "a*", 20)
    best = search.find_combined(phrases, "aa*b", 20, limit=2).orderBy(F.desc("score")).collect()
    assert [r.text for r in best] == ["a b ", "a a b "]
    for bad in (0, -1, True, "5"):
        with pytest.raises(ValueError, match="positive"):
            search.find_combined(phrases, "ab", 20, limit=bad)


def test_longest():
    at = lambda e: (c := P.compile_pattern(P.Parser(e).parse())).dfa.longest(frozenset(c.classes[x] for x in (" ", PB, END)))
    assert at("abc") == 3 and at("a{2,5}|bc") == 5 and at("a*b") is None and at('"a b- c"') == 3 and at("foo&bar") == 0 and at("( a)*") is None


def test_explorer(spark, normalizer):
    counts = weighted(spark, [("ab", 3), ("ac", 5), (f"中{PB}国", 2)])
    rows = {(r.prefix, r.cnt, r.sibling_rank) for r in index.explore(counts, "a", 2).collect()}
    assert rows == {("a", 8, 1), ("ac", 5, 1), ("ab", 3, 2)}
    assert {r.prefix for r in index.explore(counts, "a").collect()} == {"a"} and index.explore(counts, "").count() == 0
    assert {r.prefix for r in index.explore(counts, "中国", normalizer=normalizer).collect()} == {"中", f"中{PB}", f"中{PB}国"}
    with pytest.raises(ValueError, match="depth"):
        index.explore(counts, "a", 0)


def test_walk_is_in_symbol_order(spark):
    got = [r.chain for r in index.walk(weighted(spark, [("ab", 1), ("a", 1), (f"a{PB}中", 1), ("a b", 1)])).collect()]
    assert got == [f"a b{END}", f"ab{END}", f"a{END}", f"a{PB}中{END}"]


def test_phrases_by_ranges(spark):
    """Prefixes that lie across many partitions add up."""
    rng = random.Random(3)
    rows = Counter(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(400))
    want = Counter()
    for chain, n in rows.items():
        parts = chain.split(" ")
        for i in range(1, len(parts) + 1):
            want[" ".join(parts[:i]) + (" " if i < len(parts) else END)] += n
    assert dict(map(tuple, index.boundary_phrases(weighted(spark, list(rows.items()))).collect())) == want


def test_load_validates(spark, tmp_path):
    index.save(weighted(spark, [("a", 0)]), str(tmp_path / "zero"))
    with pytest.raises(ValueError, match="below 1"):
        index.load(spark, str(tmp_path / "zero"))
    index.save(weighted(spark, [("a", 1)]), str(tmp_path / "cap"), {**index.METADATA, "max_chain_symbols": 9})
    with pytest.raises(ValueError, match="max_chain_symbols"):
        index.load(spark, str(tmp_path / "cap"))


def test_merge_in_rounds(spark, tmp_path):
    paths = [str(tmp_path / f"p{i}") for i in range(5)]
    for i, p in enumerate(paths):
        index.save(weighted(spark, [("a b", 1), ("c", 1 + 4 * (i == 0))]), p)
    assert dict(map(tuple, index.merge_rounds(spark, paths, fan_in=2, between=2, final=4).collect())) == {"a b": 4, "c": 8}


def test_text_files_in_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("<doc id=1>\nTitle\nbody\n</doc>\n", encoding="utf-8")
    lines = corpus.text_lines(spark, str(tmp_path / "in"))
    got = corpus.marked_lines(lines, "file", "block", "line_no").collect()
    assert sorted(map(tuple, got)) == [("Title", 10), ("body", 1)]


def test_number_format(spark):
    values = [80.0, 1.5e-7, 0.5, 123456789.0, 0.00012345, 99999999.5, 1e8, -2.5, 0.0, 1 / 3, 1e-5, 12345.678]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(corpus.general_number(F.col("x"))).collect()] == [f"{v:.8g}" for v in values]


def test_time_limit(spark):
    import time

    assert search.capped(spark.range(3), 60, lambda df: df.count()) == 3
    slow = spark.range(1, 2, 1, 1).mapInPandas(lambda it: (time.sleep(60) or b for b in it), "id long")
    with pytest.raises(TimeoutError):
        search.capped(slow, 2)
    with pytest.raises(ValueError):
        search.capped(slow, 0)


def test_ranges_of_files(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    assert markup.convert_files(spark, str(empty), str(tmp_path / "o"), {"a": "b"})["scanned"] == 0
    (empty / "a").mkdir()
    (empty / "a" / "x.txt").write_text("q")
    (empty / "b.txt").write_text("q")
    assert {(r.name, r.status) for r in markup.file_status(spark, str(empty), str(tmp_path / "o")).collect()} == {("a/x.txt", "converted"), ("b.txt", "converted")}


def test_shared_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace as N

    from lexloom.sources import staging

    conf = N(get=lambda name, default=None: None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.shared_dir(N(sparkContext=N(getConf=lambda: conf, master="spark://a:7077"), conf=conf))


def test_ranges_join_up(spark, monkeypatch):
    """Many small ranges: prefixes that go over several of them, in order, with Unicode and a hot chain."""
    monkeypatch.setattr(index.runs, "RANGE_ROWS", 15)
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(("a", "ab", "b", f"é{PB}中", "x" * 40), k=rng.randint(1, 5))), rng.randint(1, 3)) for _ in range(300)] + [("a b", 7)] * 50
    df = weighted(spark, rows).repartition(3)
    want = Counter()
    for c, n in rows:
        want[c] += n
    got = index.runs.chains(df)
    assert got.rdd.getNumPartitions() > 10
    assert [tuple(r) for r in got.collect()] == sorted(want.items(), key=lambda x: (x[0] + END).encode())
    prefixes = Counter()
    for c, n in want.items():
        for m in re.finditer(f"[ {PB}{END}]", c + END):
            prefixes[(c + END)[: m.end()]] += n
    assert dict(map(tuple, index.boundary_phrases(df).collect())) == prefixes
    for least in (2, 5, 40):
        assert dict(map(tuple, index.cut_off(df, least).collect())) == cut_by_hand(want.items(), least)


def test_counts_beyond_longs_are_an_error(spark):
    with pytest.raises(Exception, match="range of longs"):
        index.merge(weighted(spark, [("a", 2**62)]), weighted(spark, [("a", 2**62)])).collect()
    assert dict(map(tuple, index.merge(weighted(spark, [("a", 2**62), ("b", 2**62)])).collect())) == {"a": 2**62, "b": 2**62}


def test_queries_of_few_rows_write_no_index(spark):
    """Totals, symbols and nodes come from the occurrences: neither an index is written nor a chain shuffled."""
    queries._SAVED.clear()
    for name in ("total_count", "alphabet", "explore_prefixes", "explore_path", "node_children"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert "hashpartitioning(chain" not in df._jdf.queryExecution().toString() and df.count()
    assert not queries._SAVED


@pytest.mark.parametrize("expr", ["the_*", "CVC", '"a b_*"', "_*&t_{2}", "<eht>"])
def test_beginning_keeps_what_matches(spark, expr):
    rng = random.Random(9)
    counts = weighted(spark, list(Counter(" ".join(rng.choices(("the", "then", "a", "b", "bc", "bat", "t"), k=rng.randint(1, 4))) for _ in range(300)).items()))
    want = {tuple(r) for r in search.find(index.boundary_phrases(counts), expr).collect()}
    kept = search.beginning(counts, expr)
    assert want and {tuple(r) for r in search.find(index.boundary_phrases(kept), expr).collect()} == want
    assert "<" in expr or kept.count() < counts.count()


@pytest.mark.parametrize("expr", ["<eht>", "<(th)(e)n>", "t(h_*&_*e)_", "(t_&_h)e"])
def test_patterns_without_a_regular_expression_narrow_chains(spark, expr):
    rng = random.Random(10)
    counts = weighted(spark, list(Counter(" ".join(rng.choices(("the", "then", "a", "b", "bc", "bat", "t", "he"), k=rng.randint(1, 4))) for _ in range(300)).items()))
    want = {tuple(r) for r in search.find(index.boundary_phrases(counts), expr).collect()}
    kept = search.beginning(counts, expr)
    assert want and {tuple(r) for r in search.find(index.boundary_phrases(kept), expr).collect()} == want
    assert kept.count() < counts.count()


def test_searches_write_only_what_can_match(spark):
    """A search alone writes no index of all phrases, and finds what one with the index does."""
    sf = "/root/testdata/sf0.001"
    names = ("expr_quoted", "expr_nested_intersection", "expr_anagram_parts", "display_size", "find_phone_words", "unicode_search")
    queries._SAVED.clear()
    alone = {n: sorted(map(tuple, queries.QUERIES[n](spark, sf).collect())) for n in names}
    assert not queries._SAVED and alone["expr_quoted"]
    queries.q_boundary_phrases(spark, sf).count()
    assert queries._SAVED
    assert alone == {n: sorted(map(tuple, queries.QUERIES[n](spark, sf).collect())) for n in names}


def test_texts_without_a_sign_pass_at_once(monkeypatch):
    """No kind of markup is looked for where none of its signs stands, also after its removal; the rest is as it was."""
    calls = Counter()
    for name in ("drop_elements", "labelled_links"):
        monkeypatch.setattr(markup, name, lambda s, name=name, f=getattr(markup, name): (calls.update([name]), f(s))[1])
    assert markup.strip_markup("a } | -- b begin article") == "a } | -- b >begin article" and not calls
    assert markup.strip_markup("[[x|a {{b}} c]]") == "a  c" and calls == {"drop_elements": 1, "labelled_links": 1}
    assert markup.strip_markup("<!-- x }} {| a |} ] [b") == "<!-- x }}  ] [b" and markup.strip_markup("|} {{a") == "|} {{a"
    assert markup.strip_markup("ENd ART\u0131CLE") == ">ENd ART\u0131CLE"


def test_latin_lines_need_no_python(spark, normalizer):
    """Lines of Latin-1 letters are normalised by built-in functions as the Normalizer does, every code point of them."""
    points = [chr(c) for c in (*range(0x20, 0x3000), *range(0xA720, 0xA800), *range(0xFB00, 0xFB10), *range(0xFF00, 0xFFF0), 0x4E2D, 0x1D400, 0x1F600)]
    rng = random.Random(12)
    some = "aZ09'\u2019 éÉßÿŒœ\u0301αŁ-–\u0130İıſµªǅ中か\u3099"
    lines = [f"a{c}b'{c}'c {c}{c}" for c in points] + ["".join(rng.choices(some, k=rng.randint(1, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    wrong = [(r.line, r.normalized) for r in normalize.corpus_text(df, "line").collect() if r.normalized != normalizer.corpus(r.line)]
    assert not wrong
    _, hard = normalize.latin_tables(normalizer.ranges)
    assert not re.search(hard, "Éa l\u2019été, Straße – ça") and re.search(hard, "a\u0301") and re.search(hard, "中")


def test_many_marks_fail_fast(spark):
    """A pattern that fails on a long row of marks takes no time that doubles with each of them."""
    regex = re.compile(P.to_regex(P.Parser("_*er").parse()))
    began = time.perf_counter()
    assert regex.fullmatch("a " * 24 + "x") is None and time.perf_counter() - began < 1
    assert all(regex.fullmatch(x) for x in ("er", "a er", "aa b e r ", " xer"))


SEARCHES = [e for e, _ in queries.EXPRESSIONS.values()] + ["the_*", "th_{3}", "_?the", "[_ ][^_]a", "(a-){2}b", "<a(bc)a>", "(ab*|c)d", "[^a]b", "a_{38}", "a_{39}", "(_*&a_{3})b", "時|ab", "<ehrt>"]


def test_first_symbols_of_chains_lose_no_match(spark, normalizer):
    draw = random.Random(5)
    words = ["the", "th", "he", "a", "ab", "abc", "er", "in", "of", "and", "ther", "o", "7", "7a", "est", "時", f"時{PB}代", "a" * 41, "ab" * 45, "c" * 39]
    lines = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 30))) for _ in range(150)]
    rows = spark.createDataFrame([(x,) for x in lines], "text string")
    full = index.boundary_phrases(index.chain_counts(rows)).persist()
    for expr in SEARCHES:
        where, first = P.lookahead(expr, normalizer), P.longest(expr, normalizer) + 1
        some = search.beginning(index.occurrences(rows, where=where, first=first), expr, normalizer=normalizer)
        part = index.boundary_phrases(some, sample=(some, 1.0))
        got, want = (sorted(map(tuple, search.find(x, expr, normalizer=normalizer).collect())) for x in (part, full))
        assert got == want, expr
    full.unpersist()


def test_search_moves_only_what_can_match(spark, capsys):
    sf = "/root/testdata/sf0.001"
    queries._SAVED.clear()
    text = F.regexp_replace("phrase", f"[ {PB}{END}]", "")
    assert queries.candidates(spark, sf, "th_{3}").agg(F.max(F.char_length(text))).first()[0] <= 6  # whole chains before: 40
    found = queries.QUERIES["expr_search"](spark, sf)
    found.explain("simple")
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1  # the edges of ranges; all results before
    assert found.count() == found.select("text").distinct().count()


def test_one_saved_index_is_cut_off_without_a_shuffle(spark, monkeypatch, tmp_path):
    """Its files have a range each; several of them, and not neighbours, come in one partition."""
    monkeypatch.setattr(index.runs, "RANGE_ROWS", 15)
    rng = random.Random(6)
    rows = Counter({" ".join(rng.choices(("a", "ab", "b", f"é{PB}中", "x" * 40), k=rng.randint(1, 6))): rng.randint(1, 3) for _ in range(600)})
    paths = [str(tmp_path / f"i{i}") for i in range(3)]
    index.save(weighted(spark, list(rows.items())).repartition(3), paths[0])
    for p in paths[1:]:
        index.save(weighted(spark, [("b", 9)]), p)
    saved = index.load(spark, paths[0])
    assert len(saved.inputFiles()) > 20 and saved.rdd.getNumPartitions() < len(saved.inputFiles())
    assert "Exchange" not in index.runs.folded_in_order(saved, 2)._jdf.queryExecution().toString()
    for least in (2, 5, 40):
        assert dict(map(tuple, index.cut_off(saved, least, in_order=True).collect())) == cut_by_hand(rows.items(), least)
    batch = Counter(cut_by_hand(rows.items(), 2))
    batch["b"] += 18
    got = index.merge_rounds(spark, [paths[1], paths[2], paths[0]], fan_in=2, between=2, final=5)
    assert dict(map(tuple, got.collect())) == cut_by_hand(batch.items(), 5)


def test_parts_deal_their_documents_once(spark, monkeypatch):
    """The bounds of a part's ranges come from the raw lines."""
    dealt = []
    monkeypatch.setattr(corpus, "spread", lambda df, spread=corpus.spread: (dealt.append(1), spread(df))[1])
    counted = []
    real = index.sampled
    monkeypatch.setattr(index, "sampled", lambda lines, *a, **k: (counted.append("Exchange" in lines._jdf.queryExecution().toString()), real(lines, *a, **k))[1])
    queries.part_indexes(spark, "/root/testdata/sf0.001", 2)
    assert len(dealt) == 2 and counted == [False, False]


def test_rows_in_order_are_not_sorted_again(monkeypatch):
    pa, pc = index.runs.pa, index.runs.pc
    up = lambda rows: [x.to_pylist() for x in index.runs.add_up(pa.chunked_array([pa.array([r[0] for r in rows], pa.large_string())]), pa.array([r[1] for r in rows], pa.int64()))]
    assert up([("b", 1), ("a", 2), ("b", 3)]) == [["a", "b"], [2, 4]] and up([("a", 1), ("a", 1)]) == [["a"], [2]] and up([("a", 1)]) == [["a"], [1]]
    monkeypatch.setattr(pc, "sort_indices", None)
    assert up([("a", 1), (f"a{END}", 2), ("é", 3), (PB, 4)]) == [["a", f"a{END}", "é", PB], [1, 2, 3, 4]]
