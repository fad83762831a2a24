"""Text rules as column expressions: white space, words, bytes, lines and file names.

White space means the 29 characters that Python's ``str.isspace`` accepts in
the basic plane, written out because Java's classes differ from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space characters, as ranges of code points.
SPACES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _class(ranges) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


#: White space, as the inside of a regex class; and all other characters, the most frequent ones first, as Java tries them in turn.
SPACE = _class(SPACES)
OTHER = "!-~" + _class(zip([0, *(b + 1 for _, b in SPACES)], [*(a - 1 for a, _ in SPACES), 0x10FFFF]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_newlines(text: Column | str) -> Column:
    r"""``\r\n`` and lone ``\r`` become ``\n``."""
    return F.replace(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def split_lines(text: Column | str) -> Column:
    r"""Array of lines that keep their ``\n``; an empty text has none."""
    parts = F.split(normalise_newlines(text), r"(?<=\n)", -1)
    return F.filter(parts, lambda x: x != "")


def count_newlines(text: Column | str) -> Column:
    r"""Line ends of any kind, without cutting the text."""
    plain = normalise_newlines(text)
    return (F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit("\n"), F.lit("")))).cast("long")


def count_words(text: Column | str) -> Column:
    """Maximal runs of characters that are not white space."""
    return F.coalesce(F.size(F.regexp_extract_all(_col(text), F.lit(f"[{OTHER}]+"), F.lit(0))), F.lit(0)).cast("long")


def count_bytes(text: Column | str) -> Column:
    """UTF-8 octets."""
    return F.octet_length(_col(text)).cast("long")


def is_blank(text: Column | str) -> Column:
    return ~F.rlike(_col(text), F.lit(f"[{OTHER}]"))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(text: Column | str) -> Column:
    """Stripped; null becomes empty."""
    return F.coalesce(strip(text), F.lit(""))


def collapse(text: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"[{SPACE}]+", " "), "^ | $", "")


def drop_blank_lines(text: Column | str) -> Column:
    """Lines stripped, blank ones left out."""
    return F.array_join(F.filter(F.transform(F.split(_col(text), "\n", -1), strip), lambda x: x != ""), "\n")


def contains_any(text: Column | str, needles: list[str]) -> Column:
    """Whether any of the literal strings occurs."""
    if not needles or isinstance(needles, str):
        raise ValueError("needles is a non-empty list of strings")
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(_col(text), F.lit(n))
    return out


def chat_file_number(name: Column | str) -> Column:
    """Order of chat export files: messages.html is 1, messagesN.html is N, others 0."""
    n = F.regexp_extract(_col(name), r"messages(\d+)\.html", 1)
    return F.when(_col(name) == "messages.html", F.lit(1)).when(n == "", F.lit(0)).otherwise(n.try_cast("long")).cast("long")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def extension(name: Column | str) -> Column:
    """From the last dot on; a name of leading dots only has none."""
    return F.regexp_extract(_col(name), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column | str) -> Column:
    return F.substring(_col(name), F.lit(1), F.length(_col(name)) - F.length(extension(name)))


def part_name(name: Column | str, part_no: Column | str) -> Column:
    """``{stem}_part_{n}{extension}`` of a file's base name."""
    return F.concat(stem(name), F.lit("_part_"), _col(part_no).cast("string"), extension(name))


def text_name(name: Column | str) -> Column:
    """The name with its last suffix replaced by ``.txt``."""
    return F.concat(stem(name), F.lit(".txt"))


def ceil_div(a: Column, b: int) -> Column:
    """Ceiling division of whole numbers, b > 0."""
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long")
