"""Page tables: order, numbering, pending work, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import files, text


def page_order(stem: str = "stem") -> list[Column]:
    return [text.natural_key(F.col(stem)), F.col(stem)]


def numbered(images: DataFrame, book: str = "book", stem: str = "stem", ext: str = "ext") -> DataFrame:
    """Pages 1, 2, ... of each book in natural order, ties by extension, with the name they are imported under."""
    w = Window.partitionBy(book).orderBy(*page_order(stem), F.lower(ext))
    n = F.row_number().over(w)
    return images.withColumn("page_no", n).withColumn("new_name", F.format_string("page_%03d.%s", F.col("page_no"), F.when(F.lower(ext).isin("heic", "heif"), "jpg").otherwise(F.lower(ext))))


def importable(images: DataFrame, name: str = "name") -> DataFrame:
    """Images of a folder that are imported: known extensions, no sidecars."""
    return images.where(~files.is_sidecar(F.col(name)) & files.extension(F.col(name)).isin(*files.IMPORT_EXTS))


def pending(scans: DataFrame, outputs: DataFrame, on: list[str], size: str = "size", limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Scans without an output that holds anything; the limit counts pending pages only."""
    left = scans.join(outputs.where(F.col(size) > 0).select(*on), on, "left_anti")
    return left.orderBy(*(order or [])).limit(limit) if limit is not None else left


#: Registries are small; one measured to be larger is not broadcast.
MOST_REGISTRY = 10_000


def with_default(rows: DataFrame, table: DataFrame, key: str, default: str, columns: list[str]) -> DataFrame:
    """Left join to a registry in which keys that it lacks (and nulls) take the row of `default`. Its size is measured;
    the default's values are literals."""
    known = table.select(F.col(key).alias("k_"), *(F.col(c).alias(f"{c}_") for c in columns))
    base = table.where(F.col(key) == default).select(*columns).first()
    small = F.broadcast(known) if known.limit(MOST_REGISTRY + 1).count() <= MOST_REGISTRY else known
    joined = rows.join(small, F.col(key) == F.col("k_"), "left")
    value = lambda c: F.coalesce(f"{c}_", F.lit(base[c] if base else None).cast(table.schema[c].dataType)).alias(c)
    return joined.select(*rows.columns, *map(value, columns))


def bucketed(rows: DataFrame, name: str, keys: list[str], buckets: int, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """rows as a table of the catalogue (below path, else in the warehouse), dealt by its keys into buckets once and for
    all. Tables of as many buckets are joined on these keys where they lie: what each pass does over again, pages without
    a result, then shuffles nothing. mode="append" adds to the buckets."""
    writer = rows.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)


def with_prompt(rows: DataFrame, prompts: DataFrame, lang: str = "lang", default: str = "vi") -> DataFrame:
    """rows with the `prompt` of their language (lang, prompt), blanks and case aside; the default's if there is none."""
    clean = rows.withColumn("lang_", F.lower(text.trimmed(F.col(lang))))
    found = with_default(clean, prompts.select(F.col("lang").alias("lang_"), "prompt"), "lang_", default, ["prompt"])
    return found.drop("lang_")


def attach_context(rows: DataFrame, explicit: DataFrame, cached: DataFrame, book: str = "book") -> DataFrame:
    """rows with the context block of their book: the explicitly given one, else the cached one, else ''. explicit and
    cached: book, block."""
    found = prefer(rows, [(explicit, "block"), (cached, "block")], book, "block")
    return found.withColumn("block", F.coalesce("block", F.lit("")))


def is_path(c: Column) -> Column:
    """Whether a name is a path, not a slug."""
    return c.contains("/") | c.contains("\\")


def normalized(path: Column) -> Column:
    """A path without empty, '.' and '..' parts; what would lead above the root is dropped."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda x: ~x.isin("", "."))
    step = lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def covers_within(covers: DataFrame, files_: DataFrame, root: str = "scans") -> DataFrame:
    """covers (book, cover) whose path, read from the folder `root`, is a file below it. files_: book, path."""
    inside = F.when(F.col("cover").startswith("/"), normalized(F.col("cover"))).otherwise(normalized(F.concat(F.lit(f"{root}/"), "cover")))
    named = covers.withColumn("path", inside).where(F.col("path").startswith(f"{root}/"))
    return named.join(files_.select("book", "path"), ["book", "path"], "left_semi")


def cover_candidates(pages: DataFrame, book: str = "book", page_no: str = "page_no", most: int = 5) -> DataFrame:
    """The first pages of each book, among which a cover is looked for."""
    n = F.row_number().over(Window.partitionBy(book).orderBy(page_no))
    return pages.withColumn("n_", n).where(F.col("n_") <= most).drop("n_")


def book_homes(listing: DataFrame, home: str = "home", child: str = "child") -> DataFrame:
    """Folders that are a book's home: they hold scans or dist. listing: a row for each child of a folder."""
    return listing.where(F.col(child).isin("scans", "dist")).select(home).distinct()


def importable_books(wanted: DataFrame, existing: DataFrame, book: str = "book", stem: str = "stem") -> DataFrame:
    """wanted with `blocked`: whether the book has imported pages already, which another import would mix with."""
    there = existing.where(F.col(stem).startswith("page_")).select(book).distinct().withColumn("blocked", F.lit(True))
    return wanted.join(there, book, "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def prefer(rows: DataFrame, sources: list[tuple[DataFrame, str]], on: str, out: str) -> DataFrame:
    """For each row the first non-empty value among the sources, in order: explicit before cached before ''."""
    values = []
    for i, (table, column) in enumerate(sources):
        rows = rows.join(table.select(on, F.col(column).alias(f"v{i}_")), on, "left")
        values.append(F.nullif(F.col(f"v{i}_"), F.lit("")))
    return rows.withColumn(out, F.coalesce(*values)).drop(*(f"v{i}_" for i in range(len(sources))))


def backfill(books: DataFrame, contexts: DataFrame, key: str = "slug") -> DataFrame:
    """Title, author, year and translator from the context, only for books whose title is still their slug and whose
    context has a title."""
    names = ["title", "author", "year", "translator"]
    c = contexts.select(key, *(F.col(n).alias(f"{n}_c") for n in names))
    use = (F.col("title") == F.col(key)) & (F.coalesce(F.trim("title_c"), F.lit("")) != "")
    got = {n: F.when(use, F.coalesce(F.nullif(F.col(f"{n}_c"), F.lit("")), F.col(n))).otherwise(F.col(n)) for n in names}
    return books.join(c, key, "left").select(*(got[x].alias(x) if x in got else F.col(x) for x in books.columns))


def classify_folders(items: DataFrame, folder: str = "folder", kind: str = "file_type") -> DataFrame:
    """How a folder is read: images, the one file that it holds, or 'mixed' with its histogram."""
    counts = items.groupBy(folder, kind).agg(F.count("*").alias("n"))
    per = counts.groupBy(folder).agg(
        F.bool_and(F.col(kind).isin("jpg", "png")).alias("images"), F.sum("n").alias("n_files"), F.min(kind).alias("only"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("×", kind, "n"))), ", ").alias("histogram"))
    single = (F.col("n_files") == 1) & F.col("only").isin("zip", "rar", "mobi", "pdf")
    return per.select(folder, "n_files", F.when(F.col("images"), "images").when(single, F.col("only")).otherwise("mixed").alias("route"), "histogram")


def context_sample(pages: DataFrame, book: str, order: list[Column], most: int = 15, head: int = 7, middle: int = 4, tail: int = 4) -> DataFrame:
    """Up to 15 pages all; else 7 from the start, 4 from the middle and 4 from the end."""
    n, i = F.count("*").over(Window.partitionBy(book)), F.row_number().over(Window.partitionBy(book).orderBy(*order))
    p = pages.withColumn("n_", n).withColumn("i_", i - 1)
    mid = F.floor((F.col("n_") - middle) / 2)
    keep = (F.col("n_") <= most) | (F.col("i_") < head) | F.col("i_").between(mid, mid + middle - 1) | (F.col("i_") >= F.col("n_") - tail)
    return p.where(keep).drop("n_", "i_")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").drop("rank_")


def spread_cadence(pages: DataFrame, book: str = "book", page_no: str = "page_no", first_side: str = "right") -> DataFrame:
    """Where each page of a fixed-layout book stands: the first and the landscape ones in the centre, the others on
    alternating sides that start anew behind a centre and at a reset page. pages: w, h, reset."""
    other = "left" if first_side == "right" else "right"
    run = Window.partitionBy(book).orderBy(page_no)
    centre = (F.col(page_no) == 1) | (F.col("w") > F.col("h"))
    p = pages.withColumn("centre_", centre).withColumn("group_", F.sum((centre | F.coalesce("reset", F.lit(False))).cast("int")).over(run))
    nth = F.sum((~F.col("centre_")).cast("int")).over(Window.partitionBy(book, "group_").orderBy(page_no))
    side = F.when(F.col("centre_"), "center").when(nth % 2 == 1, first_side).otherwise(other)
    return p.withColumn("spread", side).drop("centre_", "group_")
