"""Command line: python -m quire COMMAND. Tables are folders of Parquet; results are told as lines of JSON."""

from __future__ import annotations

import argparse
import shutil
import sys
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import text
from quire.operators import cost, lines, packages, pages, summaries
from quire.sources import archive_source, containers, convert
from quire.sources.scratch import scratch_dir
from quire.streaming import recognize, smoke

#: Programs that a command may need: (name, whether nothing works without it).
PROGRAMS = (("java", True), ("magick", False), ("convert", False), ("pdftoppm", False))


def tell(rows: DataFrame, most: int) -> None:
    """The first `most` rows as JSON, one a line; the tables themselves are written, not told."""
    for r in rows.select(F.to_json(F.struct("*")).alias("j")).limit(most).collect():
        print(r.j, flush=True)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with the columns of the schema; what it lacks is null."""
    return spark.read.schema(schema).parquet(path)


def import_scans(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Scans of a folder, or the pages of archives or PDFs below it, as a table of numbered pages. A book that has
    imported pages is not imported again, and a source without any page is an error."""
    if a.archives:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{cbz,zip}").load(a.source).select(F.lit(a.book).alias("book"), "content")
        images = containers.archived_images(found, ["book"]).select("book", "stem", "ext", "name", F.length("content").cast("long").alias("size"), "content", "page_no")
    elif a.pdf:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(a.source).select(F.lit(a.book).alias("book"), "content")
        rendered = convert.pdf_pages(found, ["book"])
        images = rendered.select("error", "book", F.lit("").alias("stem"), F.lit("png").alias("ext"), F.lit("").alias("name"), F.length("content").cast("long").alias("size"), "content", "page_no")
    else:
        found = pages.importable(containers.scan_images(spark, a.source)).withColumn("book", F.lit(a.book))
        images = convert.heic_to_jpg(pages.numbered(found)).select("error", "book", "stem", "ext", "name", "size", "content", "page_no")
    try:
        existing = read(spark, a.out, schemas.PAGE_IMAGES).where(F.col("book") == a.book)
        blocked = not pages.importable_books(spark.createDataFrame([(a.book,)], "book string"), existing).where("blocked").isEmpty()
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        blocked = False
    failed = 0
    if not blocked:
        path = scratch_dir(spark, "import")  # conversions run once, then what worked is imported and the rest counted
        (images if "error" in images.columns else images.withColumn("error", F.lit(None).cast("string"))).write.parquet(path)
        made = spark.read.parquet(path)
        failed = made.where("error is not null").count()
        good = made.where("error is null").drop("error")
        good.withColumn("stem", F.format_string("page_%03d", F.col("page_no"))).drop("page_no").write.mode("append").parquet(a.out)
    n = read(spark, a.out, schemas.PAGE_IMAGES).where(F.col("book") == a.book).count()
    tell(spark.range(1).select(summaries.event_line(F.lit("blocked" if blocked else "imported"), F.lit(a.book).alias("book"), F.lit(n).alias("pages"), F.lit(failed).alias("failed")).alias("line")), 1)
    return n > 0 and not blocked and not failed


def init(spark: SparkSession, a: argparse.Namespace) -> bool:
    """A row of metadata for a new book; its slug is made from the title."""
    row = spark.createDataFrame([(a.title, a.author, a.lang, a.year)], "title string, author string, lang string, year string")
    row.select(text.slugify(F.col("title")).alias("slug"), "title", "author", F.lit(None).cast("string").alias("translator"), "lang", "year").write.mode("append").parquet(a.books)
    return True


def recognize_pages(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Recognises what is still open, with the offline stub unless a caller gives another recogniser."""
    left = recognize.run_pass(spark, read(spark, a.pages, schemas.PAGE_IMAGES).select("book", "stem", "content", F.lit("").alias("prompt")), a.out, batches=a.batches)
    tell(spark.range(1).select(F.lit(left).alias("open")), 1)
    return left == 0


def book_rows(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, schemas.BOOKS).select(F.col("slug").alias("book"), "title", "author", "lang", "year", text.split_authors(F.coalesce("author", F.lit(""))).alias("authors"))


def merge(spark: SparkSession, a: argparse.Namespace) -> bool:
    """The page texts of each book as one, with its front matter; contents blocks go if --toc is given."""
    texts, books = read(spark, a.texts, schemas.PAGE_TEXT).where("md is not null").dropDuplicates(["book", "stem"]), book_rows(spark, a.books)
    merged = lines.merge_books(texts, books)
    (lines.clean_books(merged, books).select("book", "md") if a.toc else merged).write.mode("overwrite").parquet(a.out)
    tell(lines.merge_stats(texts), a.most)
    return True


def toc(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Merged books without contents blocks and empty title sections; tells what went."""
    cleaned = lines.clean_books(read(spark, a.merged, "book string, md string"), book_rows(spark, a.books))
    cleaned.select("book", "md").write.mode("overwrite").parquet(a.out)
    tell(cleaned.select("book", "removed", "demoted").orderBy("book"), a.most)
    return True


def epub(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Reflowable packages of merged books. They need no cover, so only their other gates count."""
    books = read(spark, a.books, schemas.BOOKS).select(F.col("slug").alias("book"), F.coalesce("title", "slug").alias("title"), "author", "lang", F.col("year").alias("date"))
    merged = read(spark, a.merged, "book string, md string")
    body = F.regexp_replace("md", r"(?s)\A---\n.*?\n---\n", "")
    packages.build_reflowable(merged.withColumn("md", body).join(books, "book", "left").withColumn("modified", F.lit(a.modified))).write.mode("overwrite").parquet(a.out)
    checked = packages.validate(read(spark, a.out, "book string, content binary"))
    wrong = checked.select("book", F.filter("errors", lambda e: e != "no cover image").alias("errors")).where("size(errors) > 0")
    tell(wrong.orderBy("book"), a.most)
    return wrong.isEmpty()


def tried(spark: SparkSession, a: argparse.Namespace) -> bool:
    """The trial of each book's first pages, and the rest of those that are within the budget. What was spent goes to the
    ledger below `out`; what the rest of the others would cost is told."""
    rows = read(spark, a.pages, schemas.PAGE_IMAGES).select("book", "stem", "content", F.lit("").alias("prompt"))
    told = smoke.smoke_gate(spark, rows, f"{a.out}/texts", lambda est: est <= F.lit(a.budget).cast("decimal(18,6)"))
    cost.record_pass(told.select("book", F.col("total_usd").cast("string").alias("cost_usd")), f"{a.out}/ledger", uuid.uuid4().hex)
    tell(told.orderBy("book"), a.most)
    return told.where("status <> 'full'").isEmpty()


def everything(spark: SparkSession, a: argparse.Namespace) -> bool:
    """Recognise, merge, clean and package; texts, merged books and packages are written below `out`. With a budget the
    first pages of each book are a trial, and nothing is merged before all books are within it."""
    step = lambda **more: argparse.Namespace(**(vars(a) | more))
    if a.budget is not None and not tried(spark, a):
        return False
    done = recognize_pages(spark, step(out=f"{a.out}/texts"))
    merge(spark, step(texts=f"{a.out}/texts", out=f"{a.out}/merged", toc=True))
    return epub(spark, step(merged=f"{a.out}/merged", out=f"{a.out}/epub")) and done


def package(spark: SparkSession, a: argparse.Namespace) -> bool:
    told = read(spark, a.books, schemas.IMAGE_BOOKS)
    title = text.derived_title(F.col("title"), F.col("series"), F.col("series_index"), F.col("slug"))
    books = told.select(F.col("slug").alias("book"), title.alias("title"), "author", F.coalesce("lang", F.lit("ja")).alias("lang"), F.lit(a.modified).alias("modified"), F.coalesce("rtl", F.lit(True)).alias("rtl"), F.col("year").alias("date"), "series", "series_index", "subject", "publisher", "description")
    packages.build_fixed_layout(read(spark, a.pages, schemas.PAGE_IMAGES).select("book", "stem", "ext", "content"), books).write.mode("overwrite").parquet(a.out)
    return verify(spark, argparse.Namespace(packages=a.out, most=a.most, files=False))


def verify_paths(spark: SparkSession, a: argparse.Namespace) -> bool:
    """What a path stands for (a package, a book's home, or a folder of homes), each file with its status, and how many
    there are of each; all must be whole."""
    store, top = fs.FileSystem.from_uri(a.packages)
    checked = archive_source.read_archives(spark, a.packages, content="", markEmpty=True, pathGlobFilter="*.epub").groupBy("path").agg(F.bool_and(F.coalesce("crc_ok", F.lit(False))).alias("zip_ok"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(a.packages).select(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/").alias("path"), F.col("length").alias("size"))
    found = listed.join(checked, "path", "left").select("path", "size", F.coalesce("zip_ok", F.lit(False)).alias("zip_ok"))
    homes = listed.select(F.regexp_extract("path", "^(.*)/(?:scans|work|dist)/", 1).alias("home")).where("home <> ''").distinct()
    rows = packages.verify_targets(spark.createDataFrame([(top.rstrip("/"),)], "target string"), found, homes)
    judged = rows.withColumn("status", packages.archive_status(F.col("exists"), F.col("size"), F.col("zip_ok"))).persist()
    tell(judged.select("label", "path", "size", "status").orderBy("label", "path"), a.most)
    tell(packages.verify_summary(judged), 1)
    return judged.where("status <> 'OK'").isEmpty()


def verify(spark: SparkSession, a: argparse.Namespace) -> bool:
    if a.files:
        return verify_paths(spark, a)
    checked = packages.validate(read(spark, a.packages, "book string, content binary"))
    tell(checked.orderBy("valid", "book"), a.most)
    return checked.where("not valid").isEmpty()


def ledger(spark: SparkSession, a: argparse.Namespace) -> bool:
    tell(cost.ledger_totals(read(spark, a.ledger, schemas.LEDGER), ["book"]).orderBy("book"), a.most)
    return True


def doctor(spark: SparkSession | None, a: argparse.Namespace) -> bool:
    found = {name: shutil.which(name) is not None for name, _ in PROGRAMS}
    for name, essential in PROGRAMS:
        print(f'{{"check":"{name}","ok":{str(found[name]).lower()},"essential":{str(essential).lower()}}}')
    return all(found[name] for name, essential in PROGRAMS if essential)


COMMANDS = {
    "init": (init, ("books", "title")), "import": (import_scans, ("source", "book", "out")), "recognize": (recognize_pages, ("pages", "out")), "merge": (merge, ("texts", "books", "out")),
    "toc": (toc, ("merged", "books", "out")), "epub": (epub, ("merged", "books", "out")), "all": (everything, ("pages", "books", "out")),
    "package": (package, ("pages", "books", "out")), "verify": (verify, ("packages",)), "ledger": (ledger, ("ledger",)), "doctor": (doctor, ()),
}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    """Exit code 0 if the command did all it was asked for, 1 if not, 2 for a wrong call."""
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, names) in COMMANDS.items():
        one = commands.add_parser(name, help=(f.__doc__ or "").strip() or None)
        for n in names:
            one.add_argument(n)
        one.add_argument("--most", type=int, default=1000, help="rows told at most")
        one.add_argument("--batches", type=int, default=None, help="batches of a pass; by the number of pages if not given")
        one.add_argument("--archives", action="store_true", help="import archives instead of scans")
        one.add_argument("--pdf", action="store_true", help="import PDFs instead of scans")
        one.add_argument("--budget", default=None, help="dollars that the rest of a book may cost behind its trial")
        one.add_argument("--files", action="store_true", help="verify files and homes by their paths instead of a table")
        one.add_argument("--toc", action="store_true", help="merge without contents blocks")
        for n, default in (("author", None), ("lang", "vi"), ("year", None)):
            one.add_argument(f"--{n}", default=default)
        one.add_argument("--modified", default="2024-01-01T00:00:00Z")
    a = parser.parse_args(argv)
    run = COMMANDS[a.command][0]
    if run is not doctor and spark is None:
        spark = SparkSession.builder.appName("quire").getOrCreate()
    return 0 if run(spark, a) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
