"""Queries beside their SQL on tables that hold what the small ones lack."""

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quire.operators import context, cost, packages
from quire.plans import batch_queries, queries  # noqa: F401  both register
from quire.sources import archive_source, package_facts, package_sink
from tests.compare import spark_rows, sql_rows


@pytest.fixture(scope="module")
def card_texts(spark, tmp_path_factory):
    """Documents of which some begin with 402, as card numbers do, or are nothing else; the first pages of a book among
    them."""
    path = str(tmp_path_factory.mktemp("cards"))
    text = F.expr("CASE WHEN id % 7 = 0 THEN '4024007103939509 paid' WHEN id = 22 THEN '402' WHEN id = 23 THEN '' WHEN id < 60 THEN repeat('word ', CAST(id AS INT)) END")
    spark.range(64).select(F.col("id").alias("doc_id"), text.alias("text"), F.concat(F.lit("src"), (F.col("id") % 2).cast("string")).alias("source")).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["recognized_pages", "streamed_pages", "progress_events", "smoke_gate"])
def test_texts_that_begin_with_402(spark, card_texts, name):
    assert spark_rows(queries.QUERIES[name](spark, card_texts)) == sql_rows(card_texts, queries.ORACLE_SQL[name])


def test_an_estimate_is_rounded_once(spark):
    """A hundred millionths for three pages are 100 dollars for three million, not 99.999."""
    row = spark.createDataFrame([("0.000100", 3, 3_000_000)], "usd string, ok long, remaining long")
    got = row.select(cost.smoke_estimate(F.col("usd").cast("decimal(28,6)"), F.col("ok"), F.col("remaining")).alias("est")).first().est
    assert got == 100


def test_an_answer_is_parsed_once(spark):
    """However many fields its block is made of; what is no number of pages counts as one page."""
    told = {"x": 1, " 2 ": 2, "+3": 3, "0": 1, "2.5": 1, "99999999999": 1, "": 1, "-1": -1}
    a = spark.createDataFrame([(t, f'{{"title": "t", "pages_per_image": "{t}"}}') for t in told], "t string, a string")
    blocks = a.select("t", context.render(context.parse(F.col("a"))).alias("b"))
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert {r.t: int(next(x for x in r.b.split("\n") if x.startswith(context.PER_IMAGE))[len(context.PER_IMAGE):]) for r in blocks.collect()} == told


def test_a_task_reads_its_stretch_of_a_directory(tmp_path, monkeypatch):
    """Archives of many members, one with bytes before it, one with a comment: all ranges together are all members, and
    no range makes more entries than its own. Very small splits grow rather than become very many tasks."""
    for name, before, comment in (("a.zip", b"", b""), ("b.zip", b"", b"told"), ("c.zip", b"PK before", b"")):
        path = tmp_path / name
        path.write_bytes(before)
        with zipfile.ZipFile(path, "a", zipfile.ZIP_DEFLATED) as z:
            z.comment = comment
            for i in range(2000):
                z.writestr(f"{i}.txt", f"{i} " * (i % 50))
    reader = archive_source.ArchiveReader({"path": str(tmp_path), "splitbytes": "64"})
    parts = reader.partitions()
    assert 10 < len(parts) < 1000  # over 2000 tasks before
    made = []
    whole = zipfile.ZipFile.infolist
    monkeypatch.setattr(zipfile.ZipFile, "infolist", lambda self: made.append(len(got := whole(self))) or got)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert max(made) < 1000  # 2000 before
    assert all(r["crc_ok"] and r["content"].decode() == f"{r['pos']} " * (r["pos"] % 50) for r in rows)
    assert sorted((r["path"][-5:], r["pos"]) for r in rows) == [(n, i) for n in ("a.zip", "b.zip", "c.zip") for i in range(2000)]


def long_book(spark, n):
    """The members of a package of n pages."""
    head = F.unhex(F.lit("89504E470D0A1A0A0000000D4948445200000320000004B0"))
    images = spark.range(n).select(F.lit("b").alias("book"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("stem"), F.lit("png").alias("ext"), head.alias("content"))
    books = spark.createDataFrame([("b", "T", "ja", "2024-01-01T00:00:00Z", True)], "book string, title string, lang string, modified string, rtl boolean")
    return packages.package_entries(images, books)


def test_no_row_grows_with_a_package(spark, tmp_path):
    """Neither its documents nor what is known of it when it is judged; its file is written whole."""
    n = 3000
    entries = long_book(spark, n)
    assert entries.agg(F.max(F.length("content"))).first()[0] < 100_000  # 700 000 before
    package_sink.write_packages(entries, str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "b.epub") as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist())) == 4 + 2 * n
        opf = ElementTree.fromstring(z.read("OEBPS/content.opf"))
        nav = ElementTree.fromstring(z.read("OEBPS/nav.xhtml"))
    space = "{http://www.idpf.org/2007/opf}"
    assert [r.get("idref") for r in opf.iter(f"{space}itemref")] == [f"leaf-{i:05d}" for i in range(1, n + 1)]
    assert len({i.get("href") for i in opf.iter(f"{space}item")}) == 2 * n + 1
    lists = [[a.text for a in o.iter() if a.tag.endswith("}a")] for o in nav.iter() if o.tag.endswith("}ol")]
    assert lists == [["1"], [str(i) for i in range(1, n + 1)], ["1"]]
    for split in (1 << 14, 1 << 25):
        facts = package_facts.read_package_facts(spark, str(tmp_path / "out"), splitBytes=split)
        assert {r.kind: r["count"] for r in facts.groupBy("kind").count().collect()} == {"file": 4 + 2 * n, "container": 1, "document": 1, "href": 2 * n + 1, "id": 2 * n + 1, "idref": n}
        assert [(r.valid, r.errors) for r in packages.validate_files(spark, str(tmp_path / "out"), splitBytes=split).collect()] == [(True, [])]


def test_a_package_keeps_its_directory_aside(monkeypatch):
    """Of very many members few have entries as objects, and the end of the file tells their number."""
    package = package_sink.Package(out := io.BytesIO())
    most = 0
    for i in range(70_000):  # more than an end without an extension can tell
        package.add(f"{i}", 0, b"x")
        most = max(most, len(package.zip.filelist))
    package.add("70000", 0, b"a")
    package.add("70000", 1, b"b")
    package.close()
    assert most <= package_sink.ENTRIES_AT_ONCE
    with zipfile.ZipFile(out) as z:
        assert z.namelist() == [str(i) for i in range(70_001)] and z.read("69999") == b"x" and z.read("70000") == b"ab"
    monkeypatch.setattr(archive_source, "MOST_MEMBERS", 1000)
    assert len(ranges := archive_source.ranges_of(out, None)) == 71 and ranges[0][0] == 0 and ranges[-1][1] == 70_001
    assert sum(1 for _ in package_facts.package_facts(out)) == 70_001


def test_package_documents_as_they_are_found(spark, tmp_path):
    """Files with each defect, documents that are damaged late, begin with a mark, or are a second one of the archive."""
    whole = packages.zip_books(long_book(spark, 3)).first().content
    for defect in batch_queries.DEFECTS:
        (tmp_path / f"{defect}.epub").write_bytes(batch_queries.damaged(bytes(whole), defect))
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        members = {i: z.read(i) for i in z.namelist()}
    opf = "OEBPS/content.opf"
    for name, change in {"mark": {opf: b"\xef\xbb\xbf" + members[opf]}, "late": {opf: members[opf] + b"<"}, "second": {"other.opf": b'<package><manifest><item href="none"/></manifest></package>'}, "prefix": {opf: members[opf].replace(b"<package ", b'<package xmlns:o="u" ').replace(b"<itemref ", b'<o:itemref idref="x"/><itemref ')}}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.epub", "w", zipfile.ZIP_DEFLATED) as z:
            for k, (n, c) in enumerate((members | change).items()):
                z.writestr(n, c, zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED)
    got = {r.book: r.errors for r in packages.validate_files(spark, str(tmp_path)).collect()}
    first, damaged, ill = "mimetype is not the first, stored member", "a member is damaged", "the package document is not well-formed"
    assert got == {
        "none": [], "mimetype": [first], "damaged": [damaged, first], "href": ["missing: OEBPS/gone.xhtml"], "idref": ["unknown idref: leaf-x"], "cover": ["no cover image"], "container": ["no package document named"],
        "malformed": [ill], "no_opf": ["the package document is missing"], "no_zip": [damaged, first, "no package document named"], "no_spine": ["no spine"], "mark": [], "late": [ill], "second": [], "prefix": [],
    }
    cells = spark.createDataFrame([(f.stem, bytearray(f.read_bytes())) for f in tmp_path.glob("*.epub")], "book string, content binary")
    assert {r.book: r.errors for r in packages.validate(cells).collect()} == got


def test_archives_are_judged_in_pieces(spark, monkeypatch, tmp_path):
    """No row holds an archive, whatever its size; pieces that are not together are told, not judged."""
    entries = long_book(spark, 400)
    two = entries.union(entries.withColumn("book", F.lit("c")).where("name <> 'OEBPS/scans/00007.png'"))
    monkeypatch.setattr(packages, "PIECE_BYTES", 1 << 13)  # before, a row of over 100 000 bytes for each book
    pieces = packages.zip_pieces(two)
    assert pieces.agg(F.max(F.length("content"))).first()[0] == 1 << 13 and pieces.groupBy("book").count().agg(F.min("count")).first()[0] > 10
    whole = {r.book: bytes(r.content) for r in packages.zip_books(two).collect()}
    joined = {}
    for r in pieces.orderBy("book", "piece").collect():
        joined[r.book] = joined.get(r.book, b"") + bytes(r.content)
    assert joined == whole
    assert {r.book: r.errors for r in packages.validate(pieces).collect()} == {"b": [], "c": ["missing: OEBPS/scans/00007.png"]}
    with pytest.raises(Exception, match="not together"):
        packages.validate(pieces.where("piece <> 3")).collect()
