"""Golden cases of the splitters, a sequential model on random lines, and invariants."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from loomtext.functions import chatpage, jsontext, markup
from loomtext.functions import text as T
from loomtext.operators import chat, split
from loomtext.operators.lines import explode_lines, join_files

SPACES = [chr(c) for c in range(0x10000) if chr(c).isspace()]
BOTH = ["-- Chat:", "=== Project:"]
G6 = "intro\n-- Chat: A\n\n=== Project: X\nhi\n-- Chat: B\nyo\n"


def parts(spark, content, cut):
    lines = explode_lines(spark.createDataFrame([("f", content)], "file string, content string"))
    out = defaultdict(str)
    for r in sorted(cut(lines).collect(), key=lambda r: r.line_no):
        out[r.part_no] += r.line
    return dict(out)


@pytest.mark.parametrize(
    "content,cut,want",
    [
        ("a\nb\nc", lambda x: split.by_lines(x, 2), {1: "a\nb\n", 2: "c"}),
        ("a\nb", lambda x: split.by_lines(x, -3), {1: "a\n", 2: "b"}),
        ("é\né\né\n", lambda x: split.by_bytes(x, 6), {1: "é\né\n", 2: "é\n"}),
        ("é\né\né\n", lambda x: split.by_bytes(x, 2), {1: "é\n", 2: "é\n", 3: "é\n"}),
        ("x\n" * 10, lambda x: split.by_parts(x, 6), {k: "x\nx\n" for k in range(1, 6)}),
        ("x\n" * 10, lambda x: split.by_parts(x, 0), {}),
        ("\none two three\n", lambda x: split.by_words(x, 2), {1: "\n", 2: "one two three\n"}),
        (G6, lambda x: split.by_delimiter(x, BOTH), {0: "intro\n", 2: "-- Chat: A\n\n=== Project: X\nhi\n", 3: "-- Chat: B\nyo\n"}),
        (G6, lambda x: split.by_words_at_delimiters(x, 3, BOTH), {1: "intro\n-- Chat: A\n\n=== Project: X\nhi\n", 2: "-- Chat: B\nyo\n"}),
        ("a b\nc\n", lambda x: split.by_delimiter(x, "zz"), {1: "a b\nc\n"}),
        ("\n\n--\nx", lambda x: split.by_delimiter(x, "--"), {0: "\n\n", 2: "--\nx"}),
        ("--\nx\n--\ny", lambda x: split.by_delimiter(x, "--"), {1: "--\nx\n", 2: "--\ny"}),
        ("a b c\nd\n", lambda x: split.by_words_at_delimiters(x, 1, ["zz"]), {1: "a b c\nd\n"}),
        ("a b\nc\n", lambda x: split.by_words_at_delimiters(x, 2, []), {1: "a b\n", 2: "c\n"}),
        ("", lambda x: split.by_delimiter(x, "--"), {}),
    ],
)
def test_golden_parts(spark, content, cut, want):
    assert parts(spark, content, cut) == want


def model(lines, method, limit, delims):
    """Line by line, as one would by hand."""
    out, part, held, words, size, last = [], 1, 0, 0, 0, None
    for i, line in enumerate(lines):
        w, b, hit = len(line.split()), len(line.encode()), any(d in line for d in delims)
        starts = hit and not last
        new = {"bytes": held and size + b > limit, "words": held and words + w > limit, "delim": held and words >= limit and starts}[method]
        if new:
            part, held, words, size = part + 1, 0, 0, 0
        held, words, size = held + 1, words + w, size + b
        out.append(part)
        if line.strip():
            last = hit
    return out


def test_random_files_against_the_model(spark):
    rng = random.Random(8)
    files = {}
    for k in range(25):
        n = rng.randint(0, 40)
        files[f"f{k}"] = "".join("".join(rng.choices(["a", "bé", "--", *SPACES[:12], "日", *rng.sample(SPACES, 3)], k=rng.randint(0, 9))).replace("\n", "").replace("\r", "") + rng.choice(["\n", "\r\n", "\r"]) for _ in range(n)) + rng.choice(["", "tail"])
    plain = {f: c.replace("\r\n", "\n").replace("\r", "\n") for f, c in files.items()}
    kept = {f: [x + "\n" for x in c.split("\n")[:-1]] + ([c.split("\n")[-1]] if c.split("\n")[-1] else []) for f, c in plain.items()}
    lines = explode_lines(spark.createDataFrame(list(files.items()), "file string, content string")).cache()
    for method, limit, cut in (("bytes", 9, split.by_bytes(lines, 9)), ("words", 3, split.by_words(lines, 3)), ("words", -1, split.by_words(lines, -1)), ("delim", 2, split.by_words_at_delimiters(lines, 2, ["--"])), ("delim", -1, split.by_words_at_delimiters(lines, -1, ["--"]))):
        got = defaultdict(list)
        for r in sorted(cut.collect(), key=lambda r: r.line_no):
            got[r.file].append((r.part_no, r.line))
        for f, own in kept.items():
            assert [x for _, x in got[f]] == own
            assert [p for p, _ in got[f]] == model(own, method, limit, ["--"])
    rolled = split.roll_up(split.by_delimiter(lines, "--")).collect()
    for f in files:
        assert "".join(r.content for r in sorted(rolled, key=lambda r: r.part_no) if r.file == f) == plain[f]


def test_pieces_make_one_file(spark):
    df = spark.createDataFrame([("a", 2, "x\ny"), ("a", 1, "1\n2"), ("b", 1, "")], "file string, seq int, content string")
    rows = sorted(tuple(r) for r in join_files(df).select("file", "line_no", "line").collect())
    assert rows == [("a", 0, "1\n"), ("a", 1, "2\n"), ("a", 2, "x\n"), ("a", 3, "y\n"), ("b", 0, "\n")]


def test_nulls_repeats_and_clashing_names(spark):
    rows = [("a", 0, "x y\n"), ("a", 0, "x y\n"), ("a", 1, "--\n"), (None, 0, "p\n"), (None, None, "q\n"), ("b", 3, None), ("a", None, "z\n"), ("b", 900, "-- t\n"), ("b", 10**12, "u\n")]
    df = spark.createDataFrame([(*r, "own", 7, True) for r in rows], "file string, line_no long, line string, part_no string, f int, starts boolean")
    want = {
        "words": {("a", 0): 1, ("a", 1): 2, (None, 0): 1, ("b", 3): 1, ("b", 900): 1, ("b", 10**12): 1},
        "parts": {("a", 0): 1, ("a", 1): 2, (None, 0): 1, ("b", 3): 1, ("b", 900): 1, ("b", 10**12): 2},
        "bytes": {("a", 0): 1, ("a", 1): 2, (None, 0): 1, ("b", 3): 1, ("b", 900): 2, ("b", 10**12): 3},
        "delimiter": {("a", 0): 0, ("a", 1): 2, (None, 0): 1, ("b", 3): 0, ("b", 900): 2, ("b", 10**12): 2},
        "at": {("a", 0): 1, ("a", 1): 2, (None, 0): 1, ("b", 3): 1, ("b", 900): 1, ("b", 10**12): 1},
    }
    for name, got in (("words", split.by_words(df, 3)), ("parts", split.by_parts(df, 2)), ("bytes", split.by_bytes(df, 1)), ("delimiter", split.by_delimiter(df, "--")), ("at", split.by_words_at_delimiters(df, 2, ["--"]))):
        assert got.columns == ["file", "line_no", "line", "f", "starts", "part_no"]
        out = got.collect()
        assert len(out) == len(rows)
        assert {(r.file, r.line_no or 0): r.part_no for r in out} == want[name], name
    marked = split.mark_sections(df, ["--"]).collect()
    assert len(marked) == len(rows) and {(r.file, r.line_no) for r in marked if r.starts} == {("a", 1), ("b", 900)}
    assert split.by_lines(df, 1).count() == len(rows) and split.by_words(df.limit(0), 2).count() == 0
    pieces = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y\nz"), ("a", 2, "t"), (None, 1, "n"), ("a", None, "first"), ("a", 0, None)], "file string, seq int, content string")
    got = sorted((str(r.file), r.line_no, r.line) for r in join_files(pieces).collect())
    assert got == [("None", 0, "n\n"), ("a", 0, "first\n"), ("a", 1, "x\n"), ("a", 1, "y\n"), ("a", 2, "z\n"), ("a", 3, "t\n")]


def test_white_space_is_pythons(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c]
    df = spark.createDataFrame([(c, f"a{c}b") for c in chars], "c string, s string")
    assert {r.c for r in df.filter(T.count_words("s") == 2).collect()} == set(SPACES)
    assert {r.c for r in df.filter(T.is_blank("c")).collect()} == set(SPACES)


@pytest.mark.parametrize(
    "page,want",
    [
        ("foo<b>bar</b>,", "foo bar ,"),
        ("<title>T</title><h1>H</h1>x", "T H\nx"),
        ("<p>a &amp;lt; b</p>", "a < b"),
        ("a<br><br>b", "a\nb"),
        ("<p>one<p>two", "one two"),
        ('<script>var t="</p>";</script>x', 'var t="</p>"; x'),
        ("<p/>a</br>b<hr/>c<!-- d --><ul><li>e</li></ul>", "a b\nc e"),
        ("", ""),
    ],
)
def test_markup(page, want):
    assert markup.to_text(page) == want


def test_references_without_semicolon():
    """HTML's rule decodes some of them; where a semicolon is asked for they stay, at both decodings."""
    page = "<h1>a&amp;&amp</h1>&amp;amp &amp;lt; &am &#65 &#66; & <script>x&&y</script>"
    assert markup.to_text(page) == "a&&\n& < &am A B & x&&y"
    assert markup.to_text(page, bare=False) == "a&&amp\n&amp < &am &#65 B & x&&y"


def test_json_leaves():
    assert jsontext.leaves('{"z":"1","a":2,"m":["x",{"q":"y"}],"e":""}') == ["1", "x", "y", ""]
    assert jsontext.leaves('{"a":"1","b":"2","a":"3"}') == ["3", "2"]
    assert jsontext.leaves("[NaN, true, null, 1.5]") == [] and jsontext.leaves('"s"') == ["s"]
    with pytest.raises(ValueError):
        jsontext.leaves("﻿{}")


PAGE = """<div class="message service"><div class="body details">joined</div></div>
<div class="default message"><div class="body"><div class="pull_right  date details" title="01.02">1</div>
<div class="from_name"> Ann <b>B</b> </div><div class="text">a &amp; b<br>c <a href=x>d</a><script>no</script></div></div></div>
<div class="message"><div class="body"><div class="date details pull_right" title="x"></div><div class="text"></div></div></div>
<div class="message"><div class="text">no body</div></div>"""


def test_chat_messages():
    assert chatpage.messages(PAGE) == [("01.02", "Ann B", "a & b c  d"), ("?", "System", "")]


def test_chat_cut_may_leave_part_one_empty(spark):
    rows = [("e", k, " ".join(["w"] * n)) for k, n in enumerate((6, 2, 3))]
    got = chat.cut_by_words(spark.createDataFrame(rows, "file string, line_no long, text string"), 5).orderBy("line_no").collect()
    assert [r.part_no for r in got] == [2, 3, 3]


def test_chat_files_follow_their_numbers(spark):
    rows = [("e", n, name, m, f"{name}{m}") for name, n in (("messages2.html", 2), ("messages.html", 1), ("messages_x.html", 0)) for m in range(2)]
    df = spark.createDataFrame(rows, "export string, file_no long, name string, msg_no long, text string")
    assert [r.text for r in chat.order_export(df).orderBy("line_no").collect()] == [f"{n}{m}" for n in ("messages_x.html", "messages.html", "messages2.html") for m in range(2)]
