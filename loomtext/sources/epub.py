"""EPUB packages: archive members, manifest, spine and text."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import markup

#: Where a container names its package.
CONTAINER = "META-INF/container.xml"
ROOTFILE = "{urn:oasis:names:tc:opendocument:xmlns:container}rootfile"
#: Media types that hold text contain one of these.
TEXTUAL = ("html", "xml", "text")


def package_path(archive: zipfile.ZipFile) -> str:
    """The path of the first root file; ValueError says what is missing."""
    try:
        raw = archive.read(CONTAINER)
    except KeyError:
        raise ValueError(f"the archive has no {CONTAINER}") from None
    entry = next(ET.fromstring(raw).iter(ROOTFILE), None)
    if entry is None:
        raise ValueError("the container names no root file")
    if not entry.get("full-path"):
        raise ValueError("the root file has no path")
    return entry.get("full-path")


def package(archive: zipfile.ZipFile) -> tuple[str, list[tuple[str, str, str]], list[tuple[str, str | None]]]:
    """(path, manifest items (id, href, media type), spine entries (idref, linear)), incomplete ones included."""
    path = package_path(archive)
    root = ET.fromstring(archive.read(path))
    space = re.match(r"\{[^}]+\}", root.tag)
    ns = space[0] if space else ""
    parts = {}
    for name, child in (("manifest", "item"), ("spine", "itemref")):
        section = root.find(ns + name)
        if section is None:
            raise ValueError(f"the package has no {name}")
        parts[child] = section.findall(ns + child)
    items = [(i.get("id"), i.get("href"), i.get("media-type", "").lower()) for i in parts["item"]]
    return path, items, [(i.get("idref"), i.get("linear")) for i in parts["itemref"]]


def spine_join(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, pos, idref, href, media_type) of the spine entries that are read.

    spine: (file, pos, idref, linear); manifest: (file, pos, id, href,
    media_type).  Of a repeated id the last item counts; entries marked as not
    linear, without reference, without item or of a media type that is no text
    are left out; a repeated reference repeats its section.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    last = Window.partitionBy("file", "id").orderBy(F.desc("pos"))
    items = manifest.filter(some("id") & some("href")).withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("file", F.col("id").alias("idref"), "href", F.lower(F.coalesce("media_type", F.lit(""))).alias("media_type"))
    textual = F.col("media_type") == ""
    for t in TEXTUAL:
        textual = textual | F.contains("media_type", F.lit(t))
    linear = F.lower(F.coalesce("linear", F.lit("yes"))) != "no"
    return spine.filter(linear & some("idref")).select("file", "pos", "idref").join(items, ["file", "idref"]).filter(textual).select("file", "pos", "idref", "href", "media_type")


def reading_order(items: list[tuple[str, str, str]], refs: list[tuple[str, str | None]]) -> Iterator[tuple[int, str, str]]:
    """(pos, href, media type) of the spine entries that are read, by the rules of ``spine_join``."""
    own = {i: (href, kind) for i, href, kind in items if i and href}
    for pos, (ref, linear) in enumerate(refs):
        href, kind = own.get(ref, (None, ""))
        if ref and href and (linear or "yes").lower() != "no" and (not kind or any(t in kind for t in TEXTUAL)):
            yield pos, href, kind


def read_sections(archives: DataFrame, bare: bool = True) -> DataFrame:
    """(file, pos, text) of the non-empty sections of (file, content BINARY) archives, in reading order.

    Each archive is opened once, where it lies: its package says what to read,
    and only those members are unpacked.  Members that are missing are skipped;
    a null archive has no sections.  ``bare`` is that of ``markup.to_text``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column("content")[k].as_buffer()
                rows = list(sections(raw, bare)) if raw is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column("file").take(pa.array([k] * len(rows))), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows])], ["file", "pos", "text"])

    kind = archives.schema["file"].dataType.simpleString()
    return archives.select("file", "content").mapInArrow(run, f"file {kind}, pos int, text string")


def sections(raw: pa.Buffer | bytes, bare: bool = True) -> Iterator[tuple[int, str]]:
    """(pos, text) of one archive's non-empty sections."""
    with zipfile.ZipFile(pa.BufferReader(raw)) as archive:
        path, items, refs = package(archive)
        known = set(archive.namelist())
        for pos, href, kind in reading_order(items, refs):
            if (member := markup.member_path(path, href)) in known:
                text = markup.decode(archive.read(member))
                text = (text if kind == "text/plain" else markup.to_text(text, bare)).strip()
                if text:
                    yield pos, text


def to_documents(archives: DataFrame, strict: bool = True, bare: bool = True) -> DataFrame:
    """(file, content): sections by blank lines and a newline at the end.

    An archive without a section raises, or is left out if not ``strict``.
    """
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n"))
    found = read_sections(archives, bare).groupBy("file").agg(text.alias("content"))
    if not strict:
        return found
    none = F.raise_error(F.concat(F.lit("no text in the spine of "), F.col("file")))
    return archives.select("file").join(found, "file", "left").withColumn("content", F.coalesce("content", none.cast("string")))
