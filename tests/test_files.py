"""Sources, the part sink, conversions, the command line and the stream, on real files."""

from __future__ import annotations

import zipfile

import pytest

from loomtext.operators import chat
from loomtext.plans import cli, convert
from loomtext.plans.registry import _epub
from loomtext.sources import epub, files
from loomtext.sources.parts import write_parts
from loomtext.streaming.split_stream import split_arrivals


def tree(folder):
    return {p.name: p.read_bytes().decode("utf-8-sig" if p.name.startswith("chat") else "utf-8") for p in folder.iterdir() if not p.name.startswith(".")}


def test_lines_keep_terminators_and_marks(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿x\r\ny\rz\x0c ".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.txt").write_text("no")
    rows = files.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line for r in rows] == ["﻿x\n", "y\n", "z\x0c "]


def test_malformed_bytes_raise(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\xff")
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        files.read_lines(spark, str(tmp_path)).collect()


def test_split_writes_exact_names(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.b.txt").write_bytes(b"h\n-- 1\nx\n-- 2")
    (src / "none").write_bytes(b"q\r\n")
    (src / "empty.txt").write_bytes(b"")
    out.mkdir()
    (out / "a.b_part_9.txt").write_text("stale")
    convert.split_path(spark, str(src), str(out), "delimiter", ["--"])
    assert tree(out) == {"a.b_part_0.txt": "h\n", "a.b_part_2.txt": "-- 1\nx\n", "a.b_part_3.txt": "-- 2", "none_part_1": "q\n", "a.b_part_9.txt": "stale"}


def test_parts_are_streamed_in_order_and_may_be_empty(spark, tmp_path):
    rows = [("n", k, f"{k}\n") for k in range(3000)] + [("e", 0, None)]
    write_parts(spark.createDataFrame(rows, "name string, line_no long, line string").repartition(7), str(tmp_path), "﻿")
    assert (tmp_path / "n").read_text("utf-8-sig") == "".join(r[2] for r in rows[:-1]) and (tmp_path / "e").read_bytes() == b""
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e", "n"]


def test_json_epub_and_chat_conversions(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    for kind in ("json", "epub", "chat"):
        (src / kind).mkdir(parents=True)
    (src / "json/d.json").write_text('{"a": ["x", 1, ""], "b": "é"}')
    (src / "epub/b.epub").write_bytes(_epub(4, "<p>one</p><p>two</p>"))
    message = '<div class="message"><div class="body"><div class="from_name">A</div><div class="text">{}</div></div></div>'
    (src / "chat/messages.html").write_text(message.format("a b c") + message.format("d"))
    (src / "chat/messages2.html").write_text(message.format("e"))
    (src / "chat/messages3.html").write_bytes(message.format("\xff").encode("latin-1"))
    (src / "chat/other.html").write_text(message.format("no"))
    convert.convert_json(spark, str(src / "json"), str(out / "j"))
    assert tree(out / "j") == {"d.txt": "x\n\né"}
    convert.convert_epub(spark, str(src / "epub"), str(out / "e"))
    assert tree(out / "e") == {"b.txt": "one\ntwo\n\nnote 4\n"}
    convert.convert_chat(spark, str(src / "chat"), str(out / "c"), 2)
    rule = "-" * 20
    assert tree(out / "c") == {"chat_part_1.txt": "", "chat_part_2.txt": f"[?] A: a b c\n{rule}\n", "chat_part_3.txt": f"[?] A: d\n{rule}\n[?] A: e\n{rule}\n"}
    assert (out / "c/chat_part_2.txt").read_bytes().startswith(b"\xef\xbb\xbf") and (out / "c/chat_part_1.txt").read_bytes() == b""


def test_epub_without_text_or_container_raises(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(_epub(1, "<p></p>").replace(b"note 1", b"      "))
    with zipfile.ZipFile(tmp_path / "bad.epub", "w") as z:
        z.writestr("x", "y")
    bad = files.read_bytes(spark, str(tmp_path / "bad.epub"))
    with pytest.raises(Exception, match="container.xml"):
        epub.to_documents(bad).collect()
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="p.opf"/></rootfiles></container>')
        z.writestr("p.opf", "<package><manifest/><spine/></package>")
    none = files.read_bytes(spark, str(tmp_path / "c.epub"))
    with pytest.raises(Exception, match="no text in the spine"):
        epub.to_documents(none).collect()
    assert epub.to_documents(none, strict=False).count() == 0


@pytest.mark.parametrize("args,want", [(["-l", "3"], ("lines", 3)), (["-l", "0"], ("words", 50_000)), ([], ("words", 50_000)), (["-d", "a", "b"], ("delimiter", ["a", "b"])), (["-n", "2"], ("parts", 2)), (["-b", "-1"], ("bytes", -1)), (["-w", "7"], ("words", 7))])
def test_option_choice(args, want):
    assert cli.choose(cli.parser().parse_args(["split", "p", *args])) == want


def test_stream_splits_each_file_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "a.txt").write_text("1\n2\n3\n")
    split_arrivals(spark, str(src), str(out), "lines", 2, str(ck)).awaitTermination(120)
    assert tree(out) == {"a_part_1.txt": "1\n2\n", "a_part_2.txt": "3\n"}
    (out / "a_part_1.txt").write_text("seen")
    (src / "b.txt").write_text("9")
    split_arrivals(spark, str(src), str(out), "lines", 2, str(ck)).awaitTermination(120)
    assert tree(out) == {"a_part_1.txt": "seen", "a_part_2.txt": "3\n", "b_part_1.txt": "9"}


def test_settings_and_output_files(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.txt").write_text("h\n## 1\nx y\n## 2\nz\n")
    (tmp_path / "set.json").write_text('{"input": "%s", "output_dir": "%s", "method": "delimiter", "delimiters": "##"}' % (tmp_path / "a.txt", tmp_path / "s"))
    assert cli.main(["split", "--settings", str(tmp_path / "set.json")]) == 0
    assert tree(tmp_path / "s") == {"a_part_0.txt": "h\n", "a_part_2.txt": "## 1\nx y\n", "a_part_3.txt": "## 2\nz\n"}
    assert cli.main(["split", str(tmp_path / "a.txt"), "-o", str(tmp_path / "w"), "-w", "3", "--settings", str(tmp_path / "set.json")]) == 0
    assert tree(tmp_path / "w") == {"a_part_1.txt": "h\n## 1\nx y\n", "a_part_2.txt": "## 2\nz\n"}
    (tmp_path / "bad.json").write_text('{"metod": "words"}')
    assert cli.main(["split"]) == 1 and cli.main(["split", "--settings", str(tmp_path / "bad.json")]) == 1
    assert "no input path" in (err := capsys.readouterr().err) and "metod" in err
    (tmp_path / "d.json").write_text('["x", {"k": "y"}]')
    assert cli.main(["json", str(tmp_path / "d.json"), str(tmp_path / "o/leaves")]) == 0
    assert (tmp_path / "o/leaves").read_text() == "x\ny"
    (tmp_path / "books").mkdir()
    (tmp_path / "books/b.epub").write_bytes(_epub(4, "<p>one</p>"))
    assert cli.main(["epub", str(tmp_path / "books/b.epub")]) == 0 and (tmp_path / "books/b.txt").read_text() == "one\n\nnote 4\n"
    assert cli.main(["epub", str(tmp_path / "books/b.epub"), "-o", str(tmp_path / "o/own.txt")]) == 0 and (tmp_path / "o/own.txt").read_text() == "one\n\nnote 4\n"
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / f"two/{n}.json").write_text('"s"')
    assert cli.main(["json", str(tmp_path / "two"), str(tmp_path / "o/x")]) == 1
    (tmp_path / "chat").mkdir()
    (tmp_path / "chat/messages.html").write_text('<div class="message"><div class="body"><div class="text">a b c</div></div></div>' * 3)
    assert cli.main(["chat", str(tmp_path / "chat"), "-o", str(tmp_path / "c"), "-w", "3", "--base", "p"]) == 0
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["p_1.txt", "p_2.txt", "p_3.txt"] and "3 parts" in capsys.readouterr().out


def test_directories_are_listed_by_a_task(spark, tmp_path):
    """The driver holds no list of a directory's files, and the same ones are read: none hidden, none below."""
    for k in range(300):
        (tmp_path / f"f {k}%20.txt").write_text(str(k))
    for name in (".h", "_h", "x._COPYING_"):
        (tmp_path / name).write_text("no")
    (tmp_path / "_a=b").write_text("")
    (tmp_path / "sub.txt").mkdir()
    (tmp_path / "sub.txt/f.txt").write_text("no")
    found = files.read_bytes(spark, str(tmp_path))
    assert found.inputFiles() == []
    assert {r.name: (r.file, bytes(r.content)) for r in found.collect()} == {"_a=b": (f"file:{tmp_path}/_a=b", b"")} | {f"f {k}%20.txt": (f"file:{tmp_path}/f {k}%20.txt", str(k).encode()) for k in range(300)}
    assert [r.name for r in files.read_bytes(spark, str(tmp_path), "f 1?2%*.txt").select("name").orderBy("name").collect()] == sorted(f"f 1{k}2%20.txt" for k in range(10))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_bytes(spark, str(tmp_path / "gone"))


def test_names_of_any_length_and_none_outside(spark, tmp_path):
    """Files under way have short names; a failed write leaves nothing in place and nothing hidden."""
    rows = lambda *names: spark.createDataFrame([(n, 0, n) for n in names], "name string, line_no long, line string")
    write_parts(rows("n" * 255), str(tmp_path / "o"))
    with pytest.raises(Exception, match="is no file name"):
        write_parts(rows("a", "b", "../x"), str(tmp_path / "o"))
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["n" * 255] and [p.name for p in tmp_path.iterdir()] == ["o"]


def test_chat_pages_are_parsed_once(spark, tmp_path, monkeypatch):
    """Each page is parsed once, whatever the parts need; nothing hidden stays."""
    parsed, extract = spark.sparkContext.accumulator(0), chat.extract_messages

    def counting(pages, keep):
        seen = pages.rdd.map(lambda r: (parsed.add(1), r)[1])
        return extract(spark.createDataFrame(seen, pages.schema), keep)

    monkeypatch.setattr(chat, "extract_messages", counting)
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for k in range(2, 8):
        (src / f"messages{k}.html").write_text(f'<div class="message"><div class="body"><div class="from_name">A</div><div class="text">x {k}</div></div></div>')
    assert convert.convert_chat(spark, str(src), str(out), 4) == 3
    assert parsed.value == 6
    assert sorted(p.name for p in out.iterdir()) == ["chat_part_1.txt", "chat_part_2.txt", "chat_part_3.txt"]
    assert tree(out)["chat_part_3.txt"] == f"[?] A: x 6\n{'-' * 20}\n[?] A: x 7\n{'-' * 20}\n"
