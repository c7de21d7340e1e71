"""Archives as a data source: members of zip files and records of PDB files, read by ranges.

The directory of a large archive is read where the scan is planned, and its members are dealt to as many tasks as their
bytes make; a task opens the file and reads its stretch of the directory and its members only. Small archives are dealt to tasks whole. So neither must
an archive fit into a cell, nor is one archive one task.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MEMBERS = "path string, pos int, name string, stored boolean, crc_ok boolean, size long, content binary"
ARROW = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("stored", pa.bool_()), ("crc_ok", pa.bool_()), ("size", pa.int64()), ("content", pa.binary())])
#: Bytes of members, packed as they are, that one task reads; and bytes that it hands on together.
SPLIT_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
#: Members of which a task makes directory entries at one time.
MOST_MEMBERS = 1 << 15
#: Tasks beyond which a scan's splits grow, up to SPLIT_BYTES, rather than become more.
MANY_TASKS = 256
#: An entry of a zip's directory: its mark, length, and where its packed size and the lengths of what follows stand; and
#: the record that ends a directory.
ENTRY, ENTRY_BYTES, ENTRY_SIZE, ENTRY_TAILS, ZIP_END = b"PK\1\2", 46, 20, 28, "<4s4H2LH"
# Fixed by the format: where the number of records stands, and the first entry of their table.
PDB_COUNT, PDB_TABLE = 76, 78


@dataclass
class Members(InputPartition):
    """Of each archive the members from `first` up to, not including, `behind`; all if that is None. stretch tells where
    their part of a zip's directory stands, if it is known: its place, its bytes, the directory's place, and how far
    offsets are moved by what was put before the archive."""

    ranges: list[tuple[str, int, int | None, tuple[int, int, int, int] | None]]


def is_zip(head: bytes) -> bool:
    return head[:2] == b"PK"


def directory(file: pa.NativeFile) -> zipfile.ZipFile | None:
    """A zip file by its directory; None if that is damaged."""
    try:
        return zipfile.ZipFile(file)
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is too short to be sought in
        return None


def ranges_of(file: pa.NativeFile, split: int | None) -> list[tuple[int, int, tuple[int, int, int, int]]] | None:
    """Ranges of a zip file's members, each of about `split` packed bytes, if that is given, and of MOST_MEMBERS at most,
    with their stretches of the directory. None if the directory is damaged."""
    try:  # the end is found as zipfile does, but entries are not made objects
        end = zipfile._EndRecData(file)
    except (OSError, struct.error, zipfile.BadZipFile, pa.ArrowInvalid):
        end = None
    if not end:
        return None
    size, offset, place = end[5], end[6], end[9]
    moved = place - size - offset - (zipfile.sizeEndCentDir64 + zipfile.sizeEndCentDir64Locator if end[0] == zipfile.stringEndArchive64 else 0)
    if moved + offset < 0:
        return None
    file.seek(moved + offset)
    held, at, n, packed, cuts = file.read(size), 0, 0, 0, [(0, 0)]
    while at < len(held):
        if held[at : at + 4] != ENTRY or at + ENTRY_BYTES > len(held):
            return None
        own = struct.unpack_from("<L", held, at + ENTRY_SIZE)[0]
        if n - cuts[-1][0] == MOST_MEMBERS or (split is not None and packed and packed + own > split):
            cuts.append((n, at))
            packed = 0
        packed += own
        n += 1
        at += ENTRY_BYTES + sum(struct.unpack_from("<3H", held, at + ENTRY_TAILS))
    start = moved + offset
    return [(a, b, (start + p, q - p, start, moved)) for (a, p), (b, q) in zip(cuts, [*cuts[1:], (n, at)])]


def stretch_of(file: pa.NativeFile, place: int, size: int, start: int, moved: int) -> zipfile.ZipFile:
    """A zip file of which only a stretch of the directory is read."""
    file.seek(place)
    held = file.read(size)
    archive = zipfile.ZipFile(io.BytesIO(held + struct.pack(ZIP_END, b"PK\5\6", 0, 0, 0, 0, size, 0, 0)))
    archive.fp = file
    for info in archive.infolist():
        info.header_offset += moved
    behind = start  # no member reaches into the next one, or into the directory
    for info in sorted(archive.infolist(), key=lambda i: i.header_offset, reverse=True):
        info._end_offset, behind = behind, info.header_offset
    return archive


def pdb_offsets(file: pa.NativeFile, size: int) -> list[int] | None:
    """Where the records of a PDB file begin, and its end; None if its table is damaged."""
    file.seek(0)
    head = file.read(PDB_TABLE)
    if len(head) < PDB_TABLE:
        return None
    n = struct.unpack_from(">H", head, PDB_COUNT)[0]
    table = file.read(8 * n)
    if len(table) < 8 * n:
        return None
    offsets = [struct.unpack_from(">I", table, 8 * i)[0] for i in range(n)]
    return [*offsets, size] if all(o <= size for o in offsets) else None


class ArchiveReader(DataSourceReader):
    arrow = ARROW

    def __init__(self, options: dict) -> None:
        self.store_uri = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        #: Of which members the content is wanted; of others only its check.
        self.wanted = [p for p in options.get("content", "*").split(",") if p]
        self.pattern = options.get("pathglobfilter", "*")
        #: Whether what holds no members, or is damaged, has a row of nulls.
        self.mark_empty = options.get("markempty", "false").lower() == "true"

    def partitions(self) -> list[Members]:
        store, folder = fs.FileSystem.from_uri(self.store_uri)
        top = store.get_file_info(folder)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path)
        split = max(self.split, min(SPLIT_BYTES, sum(f.size for f in files) // MANY_TASKS))
        out, held, size = [], [], 0
        for f in files:
            if f.size > split:
                out += [Members([(f.path, *part)]) for part in self.parts_of(store, f.path, f.size, split)]
                continue
            if held and size + f.size > split:
                out.append(Members(held))
                held, size = [], 0
            held.append((f.path, 0, None, None))
            size += f.size
        return [*out, Members(held)] if held or not out else out

    def parts_of(self, store: fs.FileSystem, path: str, size: int, split: int) -> list[tuple]:
        """Ranges of an archive's members, each of about `split` bytes, and their stretches of a zip's directory."""
        with store.open_input_file(path) as file:
            if is_zip(file.read(2)):
                return ranges_of(file, split) or [(0, None, None)]
            offsets = pdb_offsets(file, size) or []
        cuts, held = [0], 0
        for i, n in enumerate(b - a for a, b in zip(offsets, offsets[1:])):
            if held and held + n > split:
                cuts.append(i)
                held = 0
            held += n
        return [(a, b, None) for a, b in zip(cuts, [*cuts[1:], None])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.store_uri)
        held, size = [], 0
        for path, first, behind, stretch in partition.ranges:
            with store.open_input_file(path) as file:
                for row in self.members(file, path, first, behind, stretch):
                    held.append(row)
                    size += len(row[-1] or b"") + 256
                    if size >= BATCH_BYTES:
                        yield batch_of(held, self.arrow)
                        held, size = [], 0
        if held:
            yield batch_of(held, self.arrow)

    def members(self, file: pa.NativeFile, path: str, first: int, behind: int | None, stretch: tuple[int, int, int, int] | None) -> Iterator[tuple]:
        head = file.read(2)
        file.seek(0)
        rows = self.zip_rows(file, path, first, behind, stretch) if is_zip(head) else self.pdb_rows(file, path, first, behind)
        some = False
        for row in rows:
            some = True
            yield row
        if not some and self.mark_empty and not first:
            yield path, *[None] * (len(self.arrow) - 1)

    def zip_rows(self, file: pa.NativeFile, path: str, first: int, behind: int | None, stretch: tuple[int, int, int, int] | None) -> Iterator[tuple]:
        if stretch:
            listed = enumerate((archive := stretch_of(file, *stretch)).infolist(), first)
        else:
            archive = directory(file)
            listed = list(enumerate(archive.infolist() if archive else []))[first:behind]
        for pos, info in listed:
            if info.is_dir():
                continue
            keep, parts, ok = any(fnmatch.fnmatchcase(info.filename, p) for p in self.wanted), [], True
            try:  # what isn't wanted is checked piece by piece
                with archive.open(info) as member:
                    while part := member.read(1 << 20):
                        if keep:
                            parts.append(part)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, pa.ArrowInvalid):
                parts, ok = [], False
            yield path, pos, info.filename, info.compress_type == zipfile.ZIP_STORED, ok, info.file_size, b"".join(parts) if keep else None

    def pdb_rows(self, file: pa.NativeFile, path: str, first: int, behind: int | None) -> Iterator[tuple]:
        offsets = pdb_offsets(file, file.size())
        if offsets is None:
            return
        spans = list(enumerate(zip(offsets, offsets[1:])))[first:behind]
        for pos, (start, end) in spans:
            file.seek(start)
            yield path, pos, None, True, None, max(end - start, 0), file.read(max(end - start, 0))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, pos, name, stored, crc_ok, size, content of every member of the archives in a folder, or of one archive.

    A path is the file's in its store. Records of a PDB file have no name and no check. What is neither kind, or is
    damaged, has no rows or, with markEmpty, like an archive without members one row of nulls. content tells by
    comma-separated patterns of names of which members the bytes are wanted; of the others only their check is made.
    splitBytes is what a task reads. Members of 2 GB and more do not fit a cell.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).options(**options).load(path)
