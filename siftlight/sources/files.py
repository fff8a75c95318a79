"""Texts of document files, page by page."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from html.entities import name2codepoint
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlight.operators.chunk import MAX_CHARS, OVERLAP, chunk

EXTENSIONS = (".pdf", ".xps", ".epub", ".mobi", ".fb2", ".cbz", ".txt")


def _plain(data: bytes) -> list[str]:
    return [data.decode("utf-8", errors="replace")]


_BLOCKS = frozenset("p div section article body h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table blockquote pre title subtitle v stanza poem cite epigraph annotation text-author br hr".split())
_SILENT = frozenset(("head", "script", "style", "binary", "description"))


class _Lines:
    """Takes a document's tags and text; its lines are what stands between block tags."""

    def __init__(self):
        self.lines, self.now, self.silent = [], [], 0

    def _name(self, tag: str) -> str:
        return tag.rpartition("}")[2].lower()

    def start(self, tag, attributes=()):
        name = self._name(tag)
        self.silent += name in _SILENT
        if name in _BLOCKS:
            self._end_line()

    def end(self, tag):
        name = self._name(tag)
        self.silent -= name in _SILENT and self.silent > 0
        if name in _BLOCKS:
            self._end_line()

    def data(self, text):
        if not self.silent:
            self.now.append(text)

    def _end_line(self):
        line = re.sub(r"\s+", " ", "".join(self.now)).strip()
        self.now.clear()
        if line:
            self.lines.append(line)

    def close(self) -> str:
        self._end_line()
        return "\n".join(self.lines)


class _Loose(HTMLParser):
    """Pages that aren't well-formed."""

    def __init__(self, lines: _Lines):
        super().__init__(convert_charrefs=True)
        self.lines = lines
        self.handle_data = lines.data

    def handle_starttag(self, tag, attrs):
        self.lines.start(tag)
        if tag in ("br", "hr"):
            self.lines.end(tag)

    def handle_endtag(self, tag):
        self.lines.end(tag)


def _entities(data: bytes) -> bytes:
    """HTML's named characters by number; XML itself knows five."""
    def number(m):
        name = m[1].decode()
        known = name2codepoint.get(name)
        return m[0] if known is None or name in ("amp", "lt", "gt", "quot", "apos") else b"&#%d;" % known

    return re.sub(rb"&([A-Za-z][A-Za-z0-9]*);", number, data)


def _markup(data: bytes, loose: bool = False) -> str:
    """The text of markup, its blocks on lines of their own; all text is there once."""
    try:
        parser = ElementTree.XMLParser(target=_Lines())
        parser.feed(_entities(data))
        return parser.close()
    except ElementTree.ParseError:
        if not loose:
            raise
    lines = _Lines()
    page = _Loose(lines)
    page.feed(data.decode("utf-8", errors="replace"))
    page.close()
    return lines.close()


def _spine(book: zipfile.ZipFile) -> list[str]:
    """A book's pages in reading order: by its package's spine, or by name without one."""
    names = set(book.namelist())
    if "META-INF/container.xml" in names:
        found = next((x.get("full-path") for x in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if x.tag.endswith("rootfile")), None)
        if found in names:
            package, folder = ElementTree.fromstring(book.read(found)), posixpath.dirname(found)
            pages = {x.get("id"): posixpath.normpath(posixpath.join(folder, unquote(x.get("href", "")))) for x in package.iter() if x.tag.endswith("}item") or x.tag == "item"}
            order = [pages.get(x.get("idref")) for x in package.iter() if x.tag.rpartition("}")[2] == "itemref"]
            if order := [x for x in order if x in names]:
                return order
    return sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))


def _epub(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        return [_markup(book.read(n), loose=True) for n in _spine(book)]


def _fb2(data: bytes) -> list[str]:
    return [_markup(data)]


def _images(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        return ["" for n in book.namelist() if not n.endswith("/")]


def _rendered(kind: str) -> Callable[[bytes], list[str]]:
    def pages(data: bytes) -> list[str]:
        try:
            import fitz
        except ImportError as e:
            raise ValueError(f"{kind} files need the PyMuPDF library") from e
        with fitz.open(stream=data, filetype=kind) as document:
            return [page.get_text() for page in document]

    return pages


#: Extension -> pages of a file's bytes.
EXTRACTORS: dict[str, Callable[[bytes], list[str]]] = {
    ".txt": _plain, ".epub": _epub, ".fb2": _fb2, ".cbz": _images,
    ".pdf": _rendered("pdf"), ".xps": _rendered("xps"), ".mobi": _rendered("mobi"),
}


def find(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, content) of the supported files directly in a folder, whatever the
    case of their extension; a file that is named itself is taken whatever it is. Other
    files aren't opened."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        kinds = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in EXTENSIONS)
        reader = reader.option("pathGlobFilter", f"*{{{','.join(kinds)}}}")
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("source"), "content")


def extract_pages(files: DataFrame) -> DataFrame:
    """(source, page, text, error): pages from 1; a file that can't be read gives one row
    with its error, so that a bad file stops no job."""
    def run(batches):
        for batch in batches:
            rows = []
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = "." + source.rpartition(".")[2].lower()
                try:
                    rows += [(source, i, text, None) for i, text in enumerate(EXTRACTORS.get(kind, _plain)(data), 1)]
                except Exception as e:  # noqa: BLE001  any parser's error is a row of the report
                    rows.append((source, 0, None, f"{type(e).__name__}: {e}"))
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["source", "page", "text", "error"])

    return files.select("source", "content").mapInArrow(run, "source string, page int, text string, error string")


def extract_texts(pages: DataFrame) -> DataFrame:
    """(source, text): the pages of each file, in order, with an empty line between."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.where("error IS NULL").groupBy("source").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("text"))


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source, text) of the documents in a folder, and its quarantine. Raises ValueError if
    no document has a text."""
    pages = extract_pages(find(spark, path))
    texts = extract_texts(pages).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    if texts.isEmpty():
        raise ValueError(f"{path} has no document with a text")
    return texts, quarantine(pages)


def extract_chunks(texts: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(source, ordinal, text) per chunk."""
    return chunk(texts, "source", "text", limit, overlap)


def quarantine(pages: DataFrame) -> DataFrame:
    """(source, reason): files that failed, and files without text."""
    failed = pages.where("error IS NOT NULL").select("source", F.col("error").alias("reason"))
    empty = pages.where("error IS NULL").groupBy("source").agg(F.max(F.trim(F.coalesce("text", F.lit(""))) != "").alias("any")).where("NOT any")
    return failed.unionByName(empty.select("source", F.lit("no text").alias("reason")))
