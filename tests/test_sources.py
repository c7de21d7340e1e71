"""Archives read by ranges, and packages written by the sink."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import packages
from quire.sources import archive_source, containers, package_sink
from tests.test_operators import png


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def pdb(records):
    at = 78 + 8 * len(records)
    table = b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return b"\0" * 76 + struct.pack(">H", len(records)) + table + b"".join(records)


@pytest.fixture
def folder(tmp_path):
    members = [(f"b/p{i}.png", png(500, 500, 2000) + bytes([i % 256]) * 50) for i in range(40)] + [("b/", b""), ("notes.txt", b"x" * 3000)]
    files = {"one.cbz": zipped(members), "two.zip": zipped([("a.jpg", b"1")]), "empty.zip": zipped([]), "bad.zip": b"PK\3\4 no directory", "other.bin": b"neither", "book.mobi": pdb([b"title", png(9, 9, 5000), b"", b"gif" * 900]), "short.mobi": b"\0" * 80, "_hidden.zip": zipped(members)}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "three.zip").write_bytes(zipped([("c.txt", b"c")]))
    return tmp_path, members, files


def test_one_archive_is_read_by_several_tasks(spark, folder):
    path, members, _ = folder
    df = archive_source.read_archives(spark, str(path / "one.cbz"), splitBytes=400)
    tasks = df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) > 5
    got = {r.name: (bytes(r.content), r.pos, r.crc_ok, r.size) for r in df.collect()}
    assert got == {n: (c, k, True, len(c)) for k, (n, c) in enumerate(members) if not n.endswith("/")}


@pytest.mark.parametrize("split", [300, 3000, 1 << 25])
def test_members_do_not_depend_on_the_split(spark, folder, split):
    path, members, _ = folder
    rows = archive_source.read_archives(spark, str(path), splitBytes=split, markEmpty=True).collect()
    found = sorted((r.path.rpartition("/")[2], r.pos if r.pos is not None else -1, r.name or "", r.size or 0) for r in rows)
    want = [("one.cbz", k, n, len(c)) for k, (n, c) in enumerate(members) if not n.endswith("/")]
    want += [("two.zip", 0, "a.jpg", 1), ("three.zip", 0, "c.txt", 1), *((n, -1, "", 0) for n in ("empty.zip", "bad.zip", "other.bin", "short.mobi"))]
    want += [("book.mobi", k, "", n) for k, n in enumerate((5, 5000, 0, 2700))]
    assert found == sorted(want)
    assert archive_source.read_archives(spark, str(path), pathGlobFilter="*.cbz", splitBytes=split).count() == 41
    assert archive_source.read_archives(spark, str(path / "below"), pathGlobFilter="*.rar").collect() == []


def test_only_wanted_members_are_handed_on_and_all_are_checked(spark, folder):
    path, members, files = folder
    raw = bytearray(files["one.cbz"])
    raw[raw.index(b"x" * 3000) + 5] = 1  # a member that is not wanted is damaged
    (path / "below" / "hurt.zip").write_bytes(bytes(raw))
    rows = archive_source.read_archives(spark, str(path / "below"), content="*/p1.png,*.jpg").collect()
    assert {r.name for r in rows if r.content is not None} == {"b/p1.png"} and {r.name for r in rows if not r.crc_ok} == {"notes.txt"}
    same = containers.zip_members(spark.createDataFrame([("k", raw)], "k string, content binary"), ["k"], wanted="*/p1.png,*.jpg").collect()
    hurt = [r for r in rows if r.path.endswith("hurt.zip")]
    assert sorted((r.pos, r.name, r.crc_ok, r.content) for r in same) == sorted((r.pos, r.name, r.crc_ok, r.content) for r in hurt)


def entries(spark, books):
    rows = [(b, n, f"m{n}", bytes([65 + n]) * 3000) for b in books for n in range(4)]
    return spark.createDataFrame([(b, 0 if n == 0 else 4, "mimetype" if n == 0 else name, bytearray(c)) for b, n, name, c in rows], "book string, pos int, name string, content binary")


def test_packages_are_files(spark, tmp_path):
    out, books = tmp_path / "out", ["a", "b/../c", "Ünï +%", ".hid", "_x", "a b"]
    package_sink.write_packages(entries(spark, books), str(out))
    assert sorted(f.name for f in out.iterdir()) == sorted(package_sink.file_name(b) for b in books)
    for b in books:
        z = zipfile.ZipFile(out / package_sink.file_name(b))
        infos = z.infolist()
        assert z.testzip() is None and [i.filename for i in infos] == ["mimetype", "m1", "m2", "m3"]
        assert (infos[0].compress_type, infos[0].flag_bits & 8, infos[0].extra) == (zipfile.ZIP_STORED, 0, b"") and z.read("m2") == b"C" * 3000
    read = archive_source.read_archives(spark, str(out)).select(package_sink.book_of(F.col("path")).alias("b")).distinct()
    assert {r.b for r in read.collect()} == set(books)
    package_sink.write_packages(entries(spark, ["new", "a"]), str(out))
    assert len([*out.iterdir()]) == len(books) + 1
    package_sink.write_packages(entries(spark, ["new"]), str(out), "overwrite")
    assert [f.name for f in out.iterdir()] == ["new.epub"]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    package_sink.write_packages(entries(spark, ["old"]), str(out))
    before = (out / "old.epub").read_bytes()
    bad = entries(spark, [f"b{i}" for i in range(12)] + ["old"])
    bad = bad.withColumn("content", F.when((F.col("book") == "b7") & (F.col("name") == "m3"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.concat("content", F.lit(bytearray(b"more")))))
    with pytest.raises(Exception, match="lost"):
        package_sink.write_packages(bad, str(out))
    assert [f.name for f in out.iterdir()] == ["old.epub"] and (out / "old.epub").read_bytes() == before


def test_written_packages_are_valid(spark, tmp_path):
    images = spark.createDataFrame([("b", f"p{i}", "png", bytearray(png(800, 1200, 64))) for i in range(30)], "book string, stem string, ext string, content binary")
    books = spark.createDataFrame([("b", "T", "A", "vi", "2024-01-01T00:00:00Z", False)], "book string, title string, author string, lang string, modified string, rtl boolean")
    package_sink.write_packages(packages.package_entries(images, books), str(tmp_path / "out"))
    (tmp_path / "out" / "bad.epub").write_bytes(b"no zip")
    for split in (1 << 10, 1 << 25):
        got = {r.book: (r.valid, bool(r.errors)) for r in packages.validate_files(spark, str(tmp_path / "out"), splitBytes=split).collect()}
        assert got == {"b": (True, False), "bad": (False, True)}
