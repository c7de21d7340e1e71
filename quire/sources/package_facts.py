"""What validation needs to know of packages, as rows: their members, and what their documents name.

A document is parsed as it is unpacked and each name in it becomes a row, so that neither a document nor a list of
names is held, however large a package is.
"""

from __future__ import annotations

import codecs
import re
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from quire.sources.archive_source import ArchiveReader, directory, ranges_of, stretch_of

# Fixed values of the package format.
MIMETYPE, CONTAINER_PATH = "application/epub+zip", "META-INF/container.xml"
#: kind is file (a member; plain: it is stored and holds the type), container (what it names), document, or one of what
#: a document names: href (as a path in the archive), id, idref. scope is the table that key belongs to: null for paths,
#: the document for ids. errors are a document's own; ok tells that a member is whole, or a document well-formed.
FACTS = "pos int, kind string, scope string, doc string, key string, plain boolean, ok boolean, errors array<string>, content binary"
KINDS = pa.schema([("pos", pa.int32()), ("kind", pa.string()), ("scope", pa.string()), ("doc", pa.string()), ("key", pa.string()), ("plain", pa.bool_()), ("ok", pa.bool_()), ("errors", pa.list_(pa.string())), ("content", pa.binary())])
ARROW = pa.schema([("path", pa.string()), *KINDS])
READ_BYTES = 1 << 20


class Parser:
    """Elements of a document by the path of their names; those with a prefix have it as part of their name."""

    SEPARATOR = "\1"  # no document holds it

    def __init__(self) -> None:
        self.expat = expat.ParserCreate("utf-8", self.SEPARATOR)
        self.expat.namespace_prefixes = True
        self.expat.StartElementHandler, self.expat.EndElementHandler = self.start, self.end
        self.expat.XmlDeclHandler, self.expat.SkippedEntityHandler = self.declared, self.skipped
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.well, self.names = True, []

    def start(self, name: str, attributes: dict[str, str]) -> None:
        space, *rest = name.split(self.SEPARATOR)
        self.names.append(f"{rest[1]}:{rest[0]}" if len(rest) > 1 else rest[0] if rest else space)
        if len(self.names) < 4:
            self.element("/".join(self.names), attributes)

    def end(self, name: str) -> None:
        self.names.pop()

    def declared(self, version: str, encoding: str | None, standalone: int) -> None:
        """Documents are read as UTF-8; one that says it is in wider units, or in an unknown encoding, is not."""
        try:
            self.well &= not codecs.lookup(encoding or "utf-8").name.startswith(("utf-16", "utf-32"))
        except LookupError:
            self.well = False

    def skipped(self, name: str, is_parameter: bool) -> None:
        self.well &= bool(is_parameter)

    def element(self, path: str, attributes: dict[str, str]) -> None:
        raise NotImplementedError

    def feed(self, part: bytes, last: bool = False) -> None:
        if self.well:
            try:
                self.expat.Parse(self.decoder.decode(part, last).encode(), last)
            except expat.ExpatError:
                self.well = False


class Container(Parser):
    """The first path that the container names."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def element(self, path: str, attributes: dict[str, str]) -> None:
        if path == "container/rootfiles/rootfile" and "full-path" in attributes and not self.found:
            self.found.append(attributes["full-path"])


class Document(Parser):
    """A package document; the names found so far are taken from `rows`."""

    def __init__(self, pos: int, info: zipfile.ZipInfo) -> None:
        super().__init__()
        # Of copies of a book that are judged together each has documents of its own.
        self.pos, self.doc, self.root = pos, f"{pos}-{info.file_size}-{info.CRC:08x}", info.filename[: info.filename.rfind("/") + 1]
        self.rows: list[tuple] = []
        self.manifest = self.spine = self.cover = False

    def name(self, kind: str, scope: str | None, key: str) -> None:
        self.rows.append((self.pos, kind, scope, self.doc, key, None, None, None, None))

    def element(self, path: str, attributes: dict[str, str]) -> None:
        self.manifest |= path == "package/manifest"
        self.spine |= path == "package/spine"
        if path == "package/manifest/item":
            if "href" in attributes:
                self.name("href", None, self.root + attributes["href"])
            if "id" in attributes:
                self.name("id", self.doc, attributes["id"])
            self.cover |= "cover-image" in re.split(r"[ \t\n\v\f\r]+", attributes.get("properties", ""))
        elif path == "package/spine/itemref" and "idref" in attributes:
            self.name("idref", self.doc, attributes["idref"])

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def errors(self) -> list[str]:
        return [e for e, good in (("no manifest", self.manifest), ("no spine", self.spine), ("no cover image", self.cover)) if not good]


def member_facts(archive: zipfile.ZipFile, pos: int, info: zipfile.ZipInfo) -> Iterator[tuple]:
    """The rows of one member, without its package."""
    document = Document(pos, info) if info.filename.endswith(".opf") else None
    parts, ok, keep = [], True, info.filename in ("mimetype", CONTAINER_PATH)
    try:  # what isn't wanted is checked piece by piece
        with archive.open(info) as member:
            while part := member.read(READ_BYTES):
                if keep:
                    parts.append(part)
                if document:
                    document.feed(part)
                    yield from document.taken()
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, pa.ArrowInvalid):
        parts, ok = [], False
    content = b"".join(parts)
    plain = info.compress_type == zipfile.ZIP_STORED and info.filename == "mimetype" and content == MIMETYPE.encode()
    yield pos, "file", None, None, info.filename, plain, ok, None, None
    if info.filename == CONTAINER_PATH:
        container = Container()
        container.feed(content, True)
        yield pos, "container", None, None, (container.found[0] if container.well and container.found else "") or None, None, None, None, content
    if document:
        document.feed(b"", True)
        yield from document.taken()
        well = ok and document.well
        yield pos, "document", None, document.doc, info.filename, None, well, document.errors() if well else [], None


def package_facts(file: BinaryIO, ranges: list[tuple] | None = None) -> Iterator[tuple]:
    """The rows of a package, or of ranges of its members; its directory is read by stretches. What is no zip has none."""
    ranges = ranges or ranges_of(file, None)
    if ranges is None:  # found by another end, or not at all
        archive = directory(file)
        for pos, info in enumerate(archive.infolist() if archive else []):
            if not info.is_dir():
                yield from member_facts(archive, pos, info)
        return
    for first, _, stretch in ranges:
        for pos, info in enumerate((archive := stretch_of(file, *stretch)).infolist(), first):
            if not info.is_dir():
                yield from member_facts(archive, pos, info)


class FactsReader(ArchiveReader):
    """The facts of package files, dealt to tasks as archives are; a package without members has a row of nulls."""

    arrow = ARROW

    def __init__(self, options: dict) -> None:
        super().__init__({**options, "markempty": "true"})

    def zip_rows(self, file: pa.NativeFile, path: str, first: int, behind: int | None, stretch: tuple[int, int, int, int] | None) -> Iterator[tuple]:
        for fact in package_facts(file, [(first, behind, stretch)] if stretch else None):
            yield path, *fact

    def pdb_rows(self, file: pa.NativeFile, path: str, first: int, behind: int | None) -> Iterator[tuple]:
        return iter(())


class FactsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_package_facts"

    def schema(self) -> str:
        return f"path string, {FACTS}"

    def reader(self, schema: StructType) -> FactsReader:
        return FactsReader(self.options)


def read_package_facts(spark: SparkSession, path: str, **options) -> DataFrame:
    """path and FACTS of every package in a folder, or of one; options as of read_archives()."""
    spark.dataSource.register(FactsSource)
    return spark.read.format(FactsSource.name()).options(**options).load(path)
