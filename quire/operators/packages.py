"""Fixed-layout and reflowable packages: plan tables, the archive itself, and its validation."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain, count, islice
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import files, markdown, text
from quire.operators.pages import spread_cadence
from quire.sources import package_facts
from quire.sources.archive_source import batch_of
from quire.sources.package_facts import CONTAINER_PATH, MIMETYPE
from quire.sources.package_sink import Package, book_of, dealt_by_book
from quire.sources.scratch import kept

#: The size below which an archive is taken for a stub.
TINY = 10240
#: Pages whose items are one part of a document; and the numbers of the part between its lists and of its last one.
PILE, SECOND, LAST = 256, 1 << 40, 1 << 41
#: Bytes of an archive that are handed on together, and beyond which it is put into a temporary file.
PIECE_BYTES = 4 << 20
#: Rows that validation hands on together.
FACTS_AT_ONCE = 4096
#: Columns of books that the package document takes if they are there and filled, and their elements.
METADATA = (("author", "dc:creator"), ("publisher", "dc:publisher"), ("date", "dc:date"), ("subject", "dc:subject"), ("description", "dc:description"))
# Fixed values of the accessibility vocabulary, for books of images.
ACCESSIBILITY = (("accessMode", "visual"), ("accessModeSufficient", "visual"), ("accessibilityFeature", "none"), ("accessibilityHazard", "none"))
CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def layout(images: DataFrame, min_px: int = 400) -> DataFrame:
    """Pages that are large enough (undecodable ones are not), numbered anew. images: book, stem, ext, content."""
    # Sizes are read by all cores, however few files and books the images came from; and once, for the explosion of one
    # row keeps the optimiser from putting them below the shuffle and into each place that uses them.
    dealt = images.repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book", "stem")
    sized = dealt.select("*", F.explode(F.array(files.image_size(F.col("content")))).alias("size_")).select(*images.columns, "size_.w", "size_.h")
    big = sized.where(F.greatest("w", "h") >= min_px)
    n = F.row_number().over(Window.partitionBy("book").orderBy(text.natural_key(F.col("stem")), "stem", "ext"))
    return big.withColumn("page_no", n)


def leaf_path(n: Column) -> Column:
    return F.format_string("leaves/%05d.xhtml", n)


def scan_path() -> Column:
    return F.concat(F.format_string("scans/%05d.", F.col("page_no")), F.lower("ext"))


def manifest(pages: DataFrame, cover: Column | None = None) -> DataFrame:
    """book, page_no, id, href, media_type, properties: an image and a page document for each page, and the navigation."""
    name = F.format_string("%05d", F.col("page_no"))
    is_cover = F.col("page_no") == (cover if cover is not None else F.lit(1))
    item = lambda i, href, kind, props: F.struct(i.alias("id"), href.alias("href"), kind.alias("media_type"), props.alias("properties"))
    none = F.lit(None).cast("string")
    image = item(F.concat(F.lit("scan-"), name), scan_path(), files.media_type(F.col("ext")), F.when(is_cover, F.lit("cover-image")))
    page = item(F.concat(F.lit("leaf-"), name), leaf_path(F.col("page_no")), F.lit("application/xhtml+xml"), none)
    nav = F.when(F.col("page_no") == 1, F.array(item(F.lit("nav"), F.lit("nav.xhtml"), F.lit("application/xhtml+xml"), F.lit("nav")))).otherwise(F.array().cast("array<struct<id:string,href:string,media_type:string,properties:string>>"))
    return pages.select("book", "page_no", F.explode(F.concat(F.array(image, page), nav)).alias("i")).select("book", "page_no", "i.*")


def spine(pages: DataFrame, first_side: str = "right") -> DataFrame:
    placed = spread_cadence(pages if "reset" in pages.columns else pages.withColumn("reset", F.lit(False)), first_side=first_side)
    return placed.select("book", F.col("page_no").alias("pos"), F.format_string("leaf-%05d", F.col("page_no")).alias("idref"), "spread")


def double_pages(spine_rows: DataFrame) -> DataFrame:
    return spine_rows.groupBy("book").agg(F.greatest(F.count_if(F.col("spread") == "center") - 1, F.lit(0)).alias("doubles"))


def piled(rows: DataFrame, n: str, piece: Column, after: int) -> DataFrame:
    """book, part, text: the pieces of a book's rows in order of n, those of PILE numbers as one; parts count from after."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(n, piece.alias("piece_")))), lambda x: x["piece_"])
    by = rows.groupBy("book", F.floor(F.col(n) / PILE).cast("long").alias("pile_")).agg(F.array_join(held, "").alias("text"))
    return by.select("book", (F.col("pile_") + after).alias("part"), "text")


def around(books: DataFrame, *texts: tuple[int, Column]) -> DataFrame:
    """book, part, text: the given parts of each book."""
    parts = F.array(*(F.struct(F.lit(part).cast("long").alias("part"), value.alias("text")) for part, value in texts))
    return books.select("book", F.explode(parts).alias("p")).select("book", "p.*")


def opf(manifest_rows: DataFrame, spine_rows: DataFrame, books: DataFrame) -> DataFrame:
    """book, part, text: the package document of each book, in parts, so that however many pages it has none is long.
    books: book, title, author, lang, modified, rtl, and what it has of METADATA."""
    attr = F.when(F.col("properties").isNotNull(), F.concat(F.lit(' properties="'), "properties", F.lit('"'))).otherwise("")
    item = F.concat(F.lit('<item id="'), "id", F.lit('" href="'), "href", F.lit('" media-type="'), "media_type", F.lit('"'), attr, F.lit("/>"))
    ref = F.concat(F.lit('<itemref idref="'), "idref", F.lit('" properties="page-spread-'), "spread", F.lit('"/>'))
    has = lambda name: F.nullif(F.col(name).cast("string"), F.lit("")) if name in books.columns else F.lit(None).cast("string")
    element = lambda tag, value: F.concat(F.lit(f"<{tag}>"), text.xml_escape(value), F.lit(f"</{tag.split()[0]}>"))
    optional = [element(tag, has(name)) for name, tag in METADATA]
    series = F.concat(F.lit('<meta property="belongs-to-collection" id="series">'), text.xml_escape(has("series")), F.lit('</meta><meta refines="#series" property="collection-type">series</meta>'), F.coalesce(F.concat(F.lit('<meta refines="#series" property="group-position">'), has("series_index"), F.lit("</meta>")), F.lit("")))
    meta = F.concat_ws(
        "", F.lit('<dc:identifier id="id">urn:uuid:'), text.stable_id(F.concat(F.lit("quire:book:"), "book")), F.lit("</dc:identifier>"), element("dc:title", F.col("title")), *optional, element("dc:language", F.col("lang")), series,
        F.lit('<meta property="dcterms:modified">'), "modified", F.lit('</meta><meta property="rendition:layout">pre-paginated</meta><meta property="rendition:spread">landscape</meta>'), *(F.lit(f'<meta property="schema:{p}">{v}</meta>') for p, v in ACCESSIBILITY))
    direction = F.when(F.col("rtl"), "rtl").otherwise("ltr")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'), meta, F.lit("</metadata><manifest>"))
    between = F.concat(F.lit('</manifest><spine page-progression-direction="'), direction, F.lit('">'))
    own = books.dropDuplicates(["book"]).join(spine_rows.select("book").distinct(), "book", "left_semi")
    return around(own, (0, head), (SECOND, between), (LAST, F.lit("</spine></package>"))).unionByName(piled(manifest_rows, "page_no", item, 1)).unionByName(piled(spine_rows, "pos", ref, SECOND + 1))


def page_document(w: Column, h: Column, href: Column, n: Column) -> Column:
    """A leaf: the scan as a picture of its own size on a page without margins."""
    size = F.concat(F.lit("width="), w.cast("string"), F.lit(", height="), h.cast("string"))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><meta name="viewport" content="'), size, F.lit('"/><title>Leaf '), n.cast("string"),
        F.lit("</title><style>html, body, figure { margin: 0; padding: 0 } img { display: block; width: 100% }</style></head><body><figure><img alt=\"Leaf "), n.cast("string"), F.lit('" src="../'), href, F.lit('"/></figure></body></html>'))


def nav_document(pages: DataFrame) -> DataFrame:
    """book, part, text: the navigation of each book, in parts as its package document."""
    link = F.concat(F.lit('<li><a href="'), leaf_path(F.col("page_no")), F.lit('">'), F.col("page_no").cast("string"), F.lit("</a></li>"))
    begin, end = (lambda kind: F.lit(f'<nav epub:type="{kind}"><ol>')), F.lit("</ol></nav>")
    first = pages.groupBy("book").agg(F.min("page_no").alias("page_no")).select("book", link.alias("first"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body>'
    texts = (0, F.concat(F.lit(head), begin("toc"), "first", end, begin("page-list"))), (LAST, F.concat(end, begin("landmarks"), "first", end, F.lit("</body></html>")))
    return around(first, *texts).unionByName(piled(pages, "page_no", link, 1))


def packed(parts: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[str, BinaryIO]]:
    """Each book of entries and its archive, which is in memory as far as it has no more than `most` bytes (0: always)."""
    current, package, out = None, None, None
    for part in parts:
        for e in part.itertuples(index=False):
            if package is None or e.book != current:
                if package is not None:
                    package.close()
                    yield current, out
                current, package = e.book, Package(out := tempfile.SpooledTemporaryFile(most))
            package.add(e.name, e.part, e.content)
    if package is not None:
        package.close()
        yield current, out


def zip_books(entries: DataFrame) -> DataFrame:
    """book, content: one archive for each book of entries (book, pos, name, content, and part if members have parts),
    members in order of pos and name.

    A task streams over its books' members, so it holds one packed book and one batch of members, not a book's members.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for book, archive in packed(parts, 0):
            with archive:
                archive.seek(0)
                yield pd.DataFrame({"book": [book], "content": [archive.read()]})

    return dealt_by_book(entries).mapInPandas(run, "book string, content binary")


def zip_pieces(entries: DataFrame) -> DataFrame:
    """book, piece, content: zip_books() with each archive cut into pieces, from 0, that come one behind the other. So an
    archive need not fit a cell; a task holds a piece, the archive is in a temporary file meanwhile."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for book, archive in packed(parts, PIECE_BYTES):
            with archive:
                archive.seek(0)
                for n in count():
                    if not (piece := archive.read(PIECE_BYTES)):
                        break
                    yield pd.DataFrame({"book": [book], "piece": [n], "content": [piece]})

    return dealt_by_book(entries).mapInPandas(run, "book string, piece int, content binary")


def package_entries(images: DataFrame, books: DataFrame, min_px: int = 400) -> DataFrame:
    """book, pos, name, part, content: the members of a package for each book of page images, long ones in parts. Pages
    are sized and numbered once for all but the images themselves, which are not stored again."""
    scans = layout(images, min_px)
    pages = kept(scans.drop("content"))
    items = manifest(pages)
    entry = lambda df, pos, name, content, part=F.lit(0): df.select("book", F.lit(pos).alias("pos"), name.alias("name"), part.cast("long").alias("part"), content.alias("content"))
    raw = lambda c: F.encode(c, "UTF-8")
    own = pages.select("book").distinct()
    inside = lambda path: F.concat(F.lit("OEBPS/"), path)
    document = page_document(F.col("w"), F.col("h"), scan_path(), F.col("page_no"))
    parts = [
        entry(own, 0, F.lit("mimetype"), raw(F.lit(MIMETYPE))), entry(own, 1, F.lit(CONTAINER_PATH), raw(F.lit(CONTAINER))),
        entry(opf(items, spine(pages), books), 2, F.lit("OEBPS/content.opf"), raw(F.col("text")), F.col("part")), entry(nav_document(pages), 3, F.lit("OEBPS/nav.xhtml"), raw(F.col("text")), F.col("part")),
        entry(scans, 4, inside(scan_path()), F.col("content")), entry(pages, 5, inside(leaf_path(F.col("page_no"))), raw(document)),
    ]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.unionByName(p)
    return entries


def build_fixed_layout(images: DataFrame, books: DataFrame, min_px: int = 400) -> DataFrame:
    """book, content: a package for each book of page images. A package is one file, so a book is one task's work;
    package_sink writes packages that are too large for a cell."""
    return zip_books(package_entries(images, books, min_px))


def reflowable(book: str, md: str, told: dict) -> bytes:
    """One book's package: a document for each first-level section, a contents of two levels, and what is told of it:
    title, author, lang, date, and a cover (bytes) with its ext."""
    parts, esc = markdown.sections(md), markdown.escape
    title, lang = told.get("title") or book, told.get("lang") or "vi"
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="' + esc(lang) + '">'
    items, refs, links, documents = [], [], [], []
    if told.get("cover"):
        ext = (told.get("ext") or "jpg").lower()
        documents += [(f"cover.{ext}", bytes(told["cover"])), ("cover.xhtml", f'{head}<head><title>{esc(title)}</title></head><body epub:type="cover"><img alt="" src="cover.{ext}"/></body></html>'.encode())]
        items += [("cover-image", f"cover.{ext}", files.MEDIA_TYPES.get(ext, "image/jpeg"), "cover-image"), ("cover", "cover.xhtml", "application/xhtml+xml", "")]
        refs.append("cover")
    for n, part in enumerate(parts, 1):
        name, label = f"text/{n:04d}.xhtml", part.title or title
        documents.append((name, f"{head}<head><title>{esc(label)}</title></head><body>{markdown.body(part.lines)}</body></html>".encode()))
        items.append((f"text-{n:04d}", name, "application/xhtml+xml", ""))
        refs.append(f"text-{n:04d}")
        below = "".join(f'<li><a href="{name}#part-{k}">{esc(s)}</a></li>' for k, s in enumerate(part.subtitles, 1))
        links.append(f'<li><a href="{name}">{esc(label)}</a>' + (f"<ol>{below}</ol>" if below else "") + "</li>")
    nav = f'{head}<head><title>{esc(title)}</title></head><body><nav epub:type="toc"><ol>{"".join(links)}</ol></nav></body></html>'
    items.append(("nav", "nav.xhtml", "application/xhtml+xml", "nav"))
    listed = "".join(f'<item id="{i}" href="{href}" media-type="{kind}"' + (f' properties="{props}"' if props else "") + "/>" for i, href, kind, props in items)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"quire:book:{book}")
    meta = f'<dc:identifier id="id">urn:uuid:{name}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(lang)}</dc:language>'
    meta += "".join(f"<{tag}>{esc(told[key])}</{tag}>" for key, tag in METADATA if told.get(key))
    meta += '<meta property="dcterms:modified">' + esc(told.get("modified") or "2024-01-01T00:00:00Z") + "</meta>"
    package = f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{meta}</metadata><manifest>{listed}</manifest><spine>' + "".join(f'<itemref idref="{r}"/>' for r in refs) + "</spine></package>"
    package_file = Package(out := io.BytesIO())
    for path, content in [("mimetype", MIMETYPE.encode()), (CONTAINER_PATH, CONTAINER.encode()), ("OEBPS/content.opf", package.encode()), ("OEBPS/nav.xhtml", nav.encode()), *((f"OEBPS/{p}", c) for p, c in documents)]:
        package_file.add(path, 0, content)
    package_file.close()
    return out.getvalue()


def build_reflowable(merged: DataFrame) -> DataFrame:
    """book, content: a package for each merged text. merged: book, md, and what it has of title, author, lang, publisher,
    date, subject, description, modified, cover (bytes) and ext. A book is a row, so nothing is shuffled; a book without
    a text has no package."""
    names = [c for c in merged.columns if c in {"title", "lang", "modified", "cover", "ext", *(k for k, _ in METADATA)}]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                told = {k: v for k in names if isinstance(v := getattr(r, k), (str, bytes, bytearray))}
                yield pd.DataFrame({"book": [r.book], "content": [reflowable(r.book, r.md, told)]})

    return merged.where("md is not null").select("book", "md", *names).mapInPandas(run, "book string, content binary")


def missing_hrefs(manifest_rows: DataFrame, names: DataFrame, root: str = "OEBPS/") -> DataFrame:
    """Manifest entries whose file is not among the archive's (book, name)."""
    return manifest_rows.withColumn("name", F.concat(F.lit(root), "href")).join(names, ["book", "name"], "left_anti")


def dangling_idrefs(spine_rows: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    return spine_rows.join(manifest_rows.select("book", F.col("id").alias("idref")), ["book", "idref"], "left_anti")


def whole_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, BinaryIO]]:
    """Each book of (book, piece, content) and its archive, in a temporary file if it is large."""
    book, archive, n = None, None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            own, piece, content = (batch.column(k)[i] for k in range(3))
            if piece.as_py() == 0:
                if archive is not None:
                    yield book, archive
                book, archive, n = own, tempfile.SpooledTemporaryFile(PIECE_BYTES), 0
            elif archive is None or piece.as_py() != n or own != book:
                raise ValueError("an archive's pieces are not together and in order")
            archive.write(content.as_py() or b"")
            n += 1
    if archive is not None:
        yield book, archive


def validate(archives: DataFrame) -> DataFrame:
    """book, valid, errors (sorted): the seven gates of a package. archives: book, content, and piece as of zip_pieces().
    What is no zip, null included, fails for want of members. Archives of one book are judged together."""
    kind = archives.schema["book"].dataType.simpleString()
    piece = F.col("piece") if "piece" in archives.columns else F.lit(0).alias("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["book", *package_facts.KINDS.names]
        for book, archive in whole_archives(batches):
            with archive:
                facts = chain(package_facts.package_facts(archive), [(None,) * len(package_facts.KINDS)])  # the last for one without members
                while held := [*islice(facts, FACTS_AT_ONCE)]:
                    b = batch_of(held, package_facts.KINDS)
                    yield pa.RecordBatch.from_arrays([pa.array([book.as_py()] * len(held), book.type), *b.columns], names=names)

    return validate_facts(archives.select("book", piece, "content").mapInArrow(run, f"book {kind}, {package_facts.FACTS}"))


def validate_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """validate() for package files below path, which are read by ranges and need not fit a cell."""
    return validate_facts(package_facts.read_package_facts(spark, path, **options).withColumn("book", book_of(F.col("path"))))


def validate_facts(facts: DataFrame) -> DataFrame:
    """The gates over facts (book, and FACTS of package_facts). A name meets the member or id that it needs, and what is
    left of a book is its first member, its container, its documents and the names that found nothing, so no row grows
    with its pages."""
    of = lambda *kinds: F.col("kind").isin(*kinds)
    found = F.coalesce(F.max(of("file", "id")).over(Window.partitionBy("book", "scope", "key")), F.lit(False))
    b = facts.withColumn("found", found).groupBy("book").agg(
        F.min_by(F.struct("key", "plain"), F.when(of("file"), F.col("pos"))).alias("first"), F.bool_and(F.when(of("file"), F.col("ok"))).alias("crc"),
        F.max(F.when(of("container"), F.struct("content", F.col("key").alias("path"), "found"))).alias("container"),
        F.collect_list(F.when(of("document"), F.struct("pos", "doc", "key", "ok", "errors"))).alias("documents"),
        F.collect_set(F.when(of("href", "idref") & ~F.col("found"), F.struct("doc", "kind", "key"))).alias("lost"))
    b = b.select("book", "first", "crc", "lost", F.col("container.path").alias("path"), F.col("container.found").alias("there"), F.get(F.array_sort(F.filter("documents", lambda d: d["key"] == F.col("container.path"))), F.lit(0)).alias("document"))
    first = F.coalesce((F.col("first.key") == "mimetype") & F.col("first.plain"), F.lit(False))
    well = F.coalesce("document.ok", F.lit(False))
    told = F.array(
        F.when(~first, "mimetype is not the first, stored member"), F.when(~F.coalesce("crc", F.lit(False)), "a member is damaged"),
        F.when(F.col("path").isNull(), "no package document named").when(~F.col("there"), "the package document is missing").when(~well, "the package document is not well-formed"))
    lost = F.transform(F.filter("lost", lambda x: well & (x["doc"] == F.col("document.doc"))), lambda x: F.concat(F.when(x["kind"] == "href", "missing: ").otherwise("unknown idref: "), x["key"]))
    errors = F.array_sort(F.concat(F.array_compact(told), F.when(well, F.col("document.errors")).otherwise(F.array().cast("array<string>")), lost))
    return b.select("book", errors.alias("errors")).select("book", (F.size("errors") == 0).alias("valid"), "errors")


def archive_status(exists: Column, size: Column, zip_ok: Column, tiny: int = TINY) -> Column:
    return F.when(~F.coalesce(exists, F.lit(False)), "MISSING").when(size < tiny, "TINY").when(~zip_ok, "BADZIP").otherwise("OK")


def verify_targets(targets: DataFrame, files_: DataFrame, homes: DataFrame) -> DataFrame:
    """target, label, path, exists, size, zip_ok: what a target stands for. A file is itself; a book's home, or each home
    in a folder of homes, is the packages of its dist folder. A home without any, and a target that is nothing, has one
    row that is not there. targets: target; files_: path, size, zip_ok; homes: home."""
    up = lambda c: F.regexp_replace(c, r"/[^/]+$", "")
    own = targets.join(files_.withColumnRenamed("path", "target"), "target").select("target", F.col("target").alias("label"), F.col("target").alias("path"), "size", "zip_ok")
    asked = homes.select("home", F.explode(F.array(F.col("home"), up(F.col("home")))).alias("target")).distinct().join(targets, "target")
    packed = files_.where(F.col("path").rlike(r"/dist/[^/]+\.epub$")).withColumn("home", up(up(F.col("path"))))
    held = asked.join(packed, "home", "left").select("target", F.col("home").alias("label"), "path", "size", "zip_ok")
    found = own.union(held)
    none = targets.join(found.select("target"), "target", "left_anti").select("target", F.col("target").alias("label"), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("boolean"))
    return found.union(none).withColumn("exists", F.col("path").isNotNull())


def verify_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: the count of each status, zero if there is none, and the total."""
    return rows.agg(*(F.count_if(F.col(status) == s).alias(s.lower()) for s in ("OK", "TINY", "BADZIP", "MISSING")), F.count("*").alias("total"))
