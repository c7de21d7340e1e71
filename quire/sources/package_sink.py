"""Packages as files, written by a sink with a commit protocol.

Tasks write their packages below a staging folder of the job; the commit moves those of the attempts that succeeded to
their names, an abort removes the staging folder. So a job that fails leaves no package, and none is seen half written.
"""

from __future__ import annotations

import io
import re
import shutil
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING = "_staging"
#: Members whose entries are objects, and bytes of entries beyond which they are put aside in a file.
ENTRIES_AT_ONCE, ASIDE_BYTES = 1024, 4 << 20


class Spool(io.RawIOBase):
    """A stream that can be sought in back to the beginning of the member being written: what lies before it has gone on
    to the file, so that memory holds one member of a package."""

    def __init__(self, out: pa.NativeFile | BinaryIO) -> None:
        self.out, self.base, self.held = out, 0, io.BytesIO()

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.base + self.held.tell()

    def seek(self, at: int, whence: int = 0) -> int:
        if whence == 2:
            self.held.seek(0, 2)
        else:
            self.held.seek(at - self.base if whence == 0 else self.held.tell() + at)
        return self.tell()

    def write(self, data: bytes) -> int:
        return self.held.write(data)

    def hand_on(self) -> None:
        self.out.write(self.held.getvalue())
        self.base, self.held = self.base + len(self.held.getvalue()), io.BytesIO()


class Package:
    """A package as it grows: the first member is stored, the others are packed, all have one date. What is packed goes
    on to `out`, the directory is kept aside until the end, so that memory holds one packed member."""

    def __init__(self, out: pa.NativeFile | BinaryIO) -> None:
        self.out, self.spool = out, Spool(out)
        self.zip = zipfile.ZipFile(self.spool, "w", zipfile.ZIP_DEFLATED)
        self.entries, self.member, self.n = tempfile.SpooledTemporaryFile(ASIDE_BYTES), None, 0

    def add(self, name: str, part: int, content: bytes) -> None:
        """A member, or what comes next of one that has parts; part 0 is its beginning."""
        if not part or self.member is None:
            self.finish()
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED if self.n else zipfile.ZIP_STORED
            self.member = self.zip.open(info, "w")
        self.member.write(content)

    def finish(self) -> None:
        if self.member is not None:
            self.member.close()
            self.spool.hand_on()
            self.member, self.n = None, self.n + 1
            if len(self.zip.filelist) >= ENTRIES_AT_ONCE:
                self.put_aside()

    def put_aside(self) -> None:
        """The entries of the last members, as a package of nothing else has them before its end."""
        with zipfile.ZipFile(only := io.BytesIO(), "w") as z:
            z.filelist += self.zip.filelist
        self.entries.write(only.getvalue()[: -zipfile.sizeEndCentDir])
        self.zip.filelist.clear()
        self.zip.NameToInfo.clear()

    def close(self) -> None:
        self.finish()
        self.put_aside()
        self.zip.fp = None  # the directory is written here
        start, size = self.spool.tell(), self.entries.tell()
        self.entries.seek(0)
        shutil.copyfileobj(self.entries, self.out, 1 << 20)
        self.entries.close()
        if self.n > zipfile.ZIP_FILECOUNT_LIMIT or max(start, size) > zipfile.ZIP64_LIMIT:
            self.out.write(struct.pack(zipfile.structEndArchive64, zipfile.stringEndArchive64, zipfile.sizeEndCentDir64 - 12, 45, 45, 0, 0, self.n, self.n, size, start))
            self.out.write(struct.pack(zipfile.structEndArchive64Locator, zipfile.stringEndArchive64Locator, 0, start + size, 1))
        n, size, start = min(self.n, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF)
        self.out.write(struct.pack(zipfile.structEndArchive, zipfile.stringEndArchive, 0, 0, n, n, size, start, 0))


@dataclass
class Written(WriterCommitMessage):
    """(staged file, name below the target) of each package of a task."""

    files: list[tuple[str, str]]


def file_name(book: str) -> str:
    """A name for a book's file: itself if that is plain, else with what isn't as hex digits, so that no two agree and
    none leaves the folder."""
    plain = re.sub(r"[^\w.-]|^[._]", lambda m: "".join(f"%{b:02x}" for b in m.group().encode("utf-8", "surrogatepass")), book, flags=re.ASCII)
    return f"{plain}.epub"


class PackageWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str]:
        store, folder = fs.FileSystem.from_uri(self.uri)
        return store, folder.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        """Rows (book, pos, name, part, content), a book's together and in order."""
        store, folder = self.place()
        done: list[tuple[str, str]] = []
        current, package, file = None, None, None
        try:
            for r in iterator:
                if package is None or r.book != current:
                    if package is not None:
                        package.close()
                        file.close()
                    staged = f"{folder}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
                    store.create_dir(staged.rpartition("/")[0], recursive=True)
                    file = store.open_output_stream(staged)
                    current, package = r.book, Package(file)
                    done.append((staged, file_name(r.book)))
                package.add(r.name, r.part, bytes(r.content))
            if package is not None:
                package.close()
        finally:
            if file is not None:
                file.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self.place()
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a book's rows were not together")
        for staged, name in files:
            store.move(staged, f"{folder}/{name}")
        if self.overwrite and store.get_file_info(folder).type == fs.FileType.Directory:
            for f in store.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and f.base_name not in names:
                    store.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self.place()
        if store.get_file_info(f"{folder}/{STAGING}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{STAGING}/{self.job}")
        if store.get_file_info(f"{folder}/{STAGING}").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{folder}/{STAGING}")):
            store.delete_dir(f"{folder}/{STAGING}")


class PackageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_packages"

    def schema(self) -> str:
        return "book string, pos int, name string, part long, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> PackageWriter:
        return PackageWriter(self.options, overwrite)


def write_packages(entries: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each book of entries (book, pos, name, content) below path, members in order of pos and name; a book
    written before is replaced, with mode="overwrite" all others go. With part, rows of one name are the parts of a
    member, the first of them 0. A task holds one packed member at a time."""
    entries.sparkSession.dataSource.register(PackageSink)
    dealt_by_book(entries).write.format(PackageSink.name()).mode(mode).save(path)


def dealt_by_book(entries: DataFrame) -> DataFrame:
    """book, pos, name, part, content: a book's entries in one task and in order. Without part, each is a whole member."""
    part = F.col("part") if "part" in entries.columns else F.lit(0)
    # By a hash of their own: a union of tables that are all dealt by book counts as dealt, though each is read apart.
    dealt = entries.select("book", F.col("pos").cast("int").alias("pos"), "name", part.cast("long").alias("part"), "content").repartition(F.xxhash64("book"))
    return dealt.sortWithinPartitions("book", "pos", "name", "part")


def book_of(path: Column) -> Column:
    """The book whose package a file is, from its path."""
    return F.url_decode(F.regexp_extract(path, r"([^/]*)\.epub$", 1))
