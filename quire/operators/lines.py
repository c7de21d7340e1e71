"""Texts as lines: fences, notes, rules, headings, contents. Whole pages are merged within their texts; where lines are
wanted as rows, windows run within one page or one book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import normal, text


def explode_lines(pages: DataFrame, md: str = "md") -> DataFrame:
    """A row for each line of each page (ends trimmed first, so none ends in an empty line); blank pages have none."""
    p = pages.withColumn(md, text.trimmed(F.col(md))).where(F.col(md) != "")
    return p.select(*(c for c in p.columns if c != md), F.posexplode(F.split(md, text.SEPARATORS)).alias("line_no", "line"))


def strip_outer_fence(lines: DataFrame, page: list[str]) -> DataFrame:
    """Pages that open with a fence keep what lies between it and the last closing fence, or all behind it."""
    w = Window.partitionBy(*page)
    opens = F.max(F.when(F.col("line_no") == 0, F.col("line").rlike(text.FENCE_OPEN))).over(w)
    last = F.max(F.when((F.col("line_no") > 0) & F.col("line").rlike(text.FENCE_CLOSE), F.col("line_no"))).over(w)
    marked = lines.withColumn("opens_", opens).withColumn("last_", last)
    inside = (F.col("line_no") > 0) & (F.col("last_").isNull() | (F.col("line_no") < F.col("last_")))
    return marked.where(~F.col("opens_") | inside).drop("opens_", "last_")


def with_fences(lines: DataFrame, page: list[str]) -> DataFrame:
    """is_fence, and in_fence: whether an odd number of fence lines precedes the line on its page."""
    before = Window.partitionBy(*page).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fenced = lines.withColumn("is_fence", F.col("line").rlike(text.FENCE_OPEN))
    return fenced.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(before), F.lit(0)) % 2 == 1)


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns computed once: a plan does not look through an explosion, so filters and later columns take them
    as they are instead of computing them again."""
    return df.select(*df.columns, F.explode(F.array(F.struct(*columns))).alias("once_")).select(*df.columns, "once_.*")


def page_notes(pages: DataFrame, page: list[str], md: str = "md") -> DataFrame:
    """The largest note number of each page outside fences, 0 if none; pages of which no line is left have no row.

    Read off each page's text as a whole: no lines are made, and only keys and numbers are shuffled.
    """
    body = F.when(F.col(md).contains("```"), text.let(text.flat(F.col(md)), text.unwrapped)).otherwise(F.nullif(text.trimmed(F.col(md)), F.lit("")))
    read = once(pages.select(*page, md), body.alias("body_")).where("body_ is not null")
    plain = F.when(F.col("body_").contains("```"), text.unfenced(F.col("body_"))).otherwise(F.col("body_"))
    most = F.when(F.col("body_").contains("[^"), F.array_max(text.note_numbers(plain)))
    return read.select(*page, F.coalesce(most, F.lit(0)).alias("n_")).groupBy(*page).agg(F.max("n_").alias("max_note"))


def note_offsets(notes: DataFrame, book: str = "book", stem: str = "stem") -> DataFrame:
    """By how much each page's notes move: the sum of the maxima of the pages before it, in natural order."""
    before = Window.partitionBy(book).orderBy(text.natural_key(F.col(stem)), stem).rowsBetween(Window.unboundedPreceding, -1)
    return notes.withColumn("note_offset", F.coalesce(F.sum("max_note").over(before), F.lit(0)))


def rewrite_rules(fenced: DataFrame) -> DataFrame:
    """Rules of dashes outside fences become asterisks, which no reader takes for metadata."""
    plain = ~F.col("is_fence") & ~F.col("in_fence") & text.is_dash_rule(F.col("line"))
    return fenced.withColumn("line", F.when(plain, F.lit(text.RULE)).otherwise(F.col("line")))


def upgrade_headings(lines: DataFrame) -> DataFrame:
    """Aware of no fences, as literal pages were always treated."""
    return lines.withColumn("line", text.upgraded_heading(F.col("line")))


def clean_contents(lines: DataFrame, title: str = "title", authors: str = "authors", book: str = "book", heads: bool = False) -> DataFrame:
    """Lines with `action`: keep, toc (within a contents block, which goes), demote (an empty section named like the
    book or an author, which becomes plain text); with heads, toc_head for the heading of a contents block. Names are
    compared as composed, whichever way either side is written."""
    run = Window.partitionBy(book).orderBy("line_no")
    name = lambda c: F.lower(text.trimmed(normal.nfc(c)))
    named = F.when(F.col("line").startswith("## "), name(F.substring(F.col("line"), F.lit(4), F.length("line"))))
    lines = once(lines, named.alias("head_"))
    head = F.col("head_")
    # The names of a contents heading.
    is_toc = head.isin("mục lục", "muc luc")
    p = lines.withColumn("toc_", F.coalesce(F.last(F.when(F.col("line").startswith("#"), F.coalesce(is_toc, F.lit(False))), ignorenulls=True).over(run), F.lit(False)))
    following = F.first(F.when(text.trimmed(F.col("line")) != "", F.col("line")), ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing))
    names = F.transform(F.concat(F.array(title), F.coalesce(authors, F.array().cast("array<string>"))), name)
    p = p.withColumn("next_", following)
    empty = F.col("next_").isNull() | F.col("next_").startswith("## ")
    # Names are looked at only where a heading stands over nothing.
    own = F.when(F.col("head_").isNotNull() & (F.col("head_") != "") & empty, F.coalesce(F.array_contains(names, F.col("head_")), F.lit(False)))
    action = F.when(F.coalesce(is_toc, F.lit(False)), "toc_head").when(F.col("toc_"), "toc").when(own, "demote").otherwise("keep")
    marked = p.withColumn("action", action).drop("head_", "toc_", "next_")
    return marked if heads else marked.withColumn("action", F.when(F.col("action") == "toc_head", "toc").otherwise(F.col("action")))


def apply_contents(marked: DataFrame) -> DataFrame:
    out = F.when(F.col("action") == "demote", text.trimmed(F.substring(F.col("line"), F.lit(4), F.length("line")))).otherwise(F.col("line"))
    return marked.where("action not in ('toc', 'toc_head')").withColumn("line", out)


def join_lines(lines: DataFrame, keys: list[str], order: list[str], sep: str = "\n", out: str = "md") -> DataFrame:
    """Lines back to one text for each key."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["line"]), sep).alias(out))


def unwrapped_pages(pages: DataFrame, book: str, stem: str, md: str) -> tuple[DataFrame, DataFrame]:
    """(book, stem, note_offset, first_line and body of each page that has a line left; note offsets of each page).

    A page is worked on as one text: only a small row for each page is shuffled for the offsets, and texts once, to
    meet theirs.
    """
    page = [book, stem]
    offsets = note_offsets(page_notes(pages, page, md), book, stem)
    texts = pages.select(*page, F.col(md).alias("md_")).repartition(*page).join(offsets.select(*page, "note_offset"), page)
    read = once(texts, text.flat(F.col("md_")).alias("flat_")).where("flat_ <> ''").drop("md_")
    read = once(read, text.is_wrapped(F.col("flat_")).cast("int").alias("first_line"), text.unwrapped(F.col("flat_")).alias("body"))
    return read.where("body is not null").drop("flat_"), offsets


def renumbered(part: Column, move: Column) -> Column:
    return F.when((move > 0) & part.contains("[^"), text.shifted_notes(part, move)).otherwise(part)


def renumbered_pages(pages: DataFrame, book: str = "book", stem: str = "stem", md: str = "md") -> tuple[DataFrame, DataFrame]:
    """(book, stem, first_line and body of each page that has a line left, notes renumbered; note offsets of each page)."""
    bodies, offsets = unwrapped_pages(pages, book, stem, md)
    moved = text.by_fences(F.col("body"), lambda part, fenced: F.when(fenced, part).otherwise(renumbered(part, F.col("note_offset"))))
    return bodies.select(book, stem, "first_line", moved.alias("body")), offsets


def cleaned_pages(pages: DataFrame, book: str = "book", stem: str = "stem", md: str = "md") -> tuple[DataFrame, DataFrame]:
    """The merge of a book up to its joined text: (book, stem and body of each page, note offsets). Outside fences notes
    are renumbered and rules of dashes become asterisks; chapter lines become headings, in fences too."""
    bodies, offsets = unwrapped_pages(pages, book, stem, md)

    def cleaned(part: Column, fenced: Column) -> Column:
        line = lambda x: F.when(~fenced & text.is_dash_rule(x), F.lit(text.RULE)).otherwise(text.upgraded_heading(x))
        return text.each_line(F.when(fenced, part).otherwise(renumbered(part, F.col("note_offset"))), line)

    return once(bodies, text.by_fences(F.col("body"), cleaned).alias("clean_")).select(book, stem, F.col("clean_").alias("body")), offsets


def book_head() -> Column:
    """The front matter of a row of books, with the line end behind it."""
    return F.concat(text.front_matter(F.col("title"), F.col("author"), F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("vi")), F.col("year")), F.lit("\n"))


def merge_stats(pages: DataFrame, book: str = "book", stem: str = "stem", md: str = "md", books: DataFrame | None = None) -> DataFrame:
    """pages_merged (empty ones too), body_chars, h1, h2 and footnotes of each book; with books (as for merge_books) also
    chars, the length of the merged book as it is written, front matter included."""
    bodies, offsets = cleaned_pages(pages, book, stem, md)
    heads = lambda mark: F.size(F.filter(F.split("body", "\n", -1), lambda x: x.startswith(mark)))
    each = bodies.select(book, F.length("body").alias("chars_"), heads("# ").alias("h1_"), heads("## ").alias("h2_"))
    per_text = each.groupBy(book).agg(F.sum("h1_").alias("h1"), F.sum("h2_").alias("h2"), (F.sum("chars_") + 2 * F.count("*") - 2).alias("chars"))  # two characters between pages
    footnotes = offsets.groupBy(book).agg(F.sum("max_note").alias("footnotes"))
    total = pages.groupBy(book).agg(F.count("*").alias("pages_merged"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    told = total.join(per_text, book, "left").join(footnotes, book, "left").select(book, "pages_merged", zero(F.col("chars")).alias("body_chars"), zero(F.col("h1")).alias("h1"), zero(F.col("h2")).alias("h2"), zero(F.col("footnotes")).alias("footnotes"))
    if books is None:
        return told
    heads_ = books.select(book, F.length(book_head()).alias("head_"))
    return told.join(heads_, book).withColumn("chars", F.col("body_chars") + F.col("head_") + 1).drop("head_")


def merge_books(pages: DataFrame, books: DataFrame, book: str = "book", stem: str = "stem", md: str = "md") -> DataFrame:
    """One row per book: front matter and body. books: book, title, author, lang, year."""
    texts, _ = cleaned_pages(pages, book, stem, md)
    keyed = texts.withColumn("key_", text.natural_key(F.col(stem))).withColumnRenamed("body", "line")
    bodies = join_lines(keyed, [book], ["key_", stem], "\n\n", "body")
    return bodies.join(books, book).select(book, F.concat(book_head(), "body", F.lit("\n")).alias("md"))


def clean_books(merged: DataFrame, books: DataFrame) -> DataFrame:
    """merged (book, md) without contents blocks and with empty title sections as plain text: book, md (ended by a line
    end), removed (contents blocks), demoted (the headings that became plain text, in order). books: book, title,
    authors ARRAY<STRING>. Books without a row in books keep all but their contents blocks."""
    told = merged.join(books.select("book", "title", "authors"), "book", "left")
    each = F.posexplode(F.split(F.regexp_replace("md", r"\n\z", ""), "\n", -1)).alias("line_no", "line")
    marked = clean_contents(told.where("md is not null").select("book", "title", "authors", each), heads=True)
    heading = F.when(F.col("action") == "demote", F.struct("line_no", text.trimmed(F.substring(F.col("line"), F.lit(4), F.length("line"))).alias("head")))
    demoted = F.transform(F.array_sort(F.collect_list(heading)), lambda x: x["head"])
    counts = marked.groupBy("book").agg(F.count_if(F.col("action") == "toc_head").alias("removed"), demoted.alias("demoted"))
    kept = counts.join(join_lines(apply_contents(marked), ["book"], ["line_no"]), "book", "left")  # of some nothing is left
    return kept.select("book", F.concat(F.coalesce("md", F.lit("")), F.lit("\n")).alias("md"), "removed", "demoted")
