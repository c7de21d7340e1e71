"""Book contexts: parsing, validation, and the block that goes with each recognition request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import json_object, let
from quire.schemas import CONTEXT

NAME_CAP = 40
#: The rules that every block begins with; a caller may give others.
RULES = (
    "Cover, title and imprint pages: plain paragraphs, never headings.",
    "All titles of chapters and parts use `## `, in both languages of a bilingual book; never `### `.",
)
VERSE_RULE = "Verse: end every line with two blanks; stanzas are divided by an empty line."
# The labels of a block's lines.
HEAD, PER_IMAGE, TOC, NAMES, TERMS, LAYOUT, NOTES, PITFALLS = "--- BỐI CẢNH SÁCH (dùng để OCR nhất quán) ---", "Số trang mỗi ảnh: ", "MỤC LỤC (cấu trúc sách): ", "Tên riêng (giữ chính tả chuẩn): ", "Thuật ngữ giữ nguyên: ", "Layout: ", "Footnote: ", "Lưu ý OCR: "


def parse(answer: Column) -> Column:
    """The context in a model's answer, fences and prose around it dropped; null unless it is an object with a title.
    Numbers that stand where texts belong are read as texts."""
    return let(F.from_json(json_object(answer), CONTEXT), lambda got: F.when(F.nullif(F.trim(got["title"]), F.lit("")).isNotNull(), got))


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def listed(label: str, items: Column, sep: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep)))


def pages_per_image(c: Column) -> Column:
    told = c["pages_per_image"]  # what is no number is told by its letters: a cast that fails costs an exception
    return F.coalesce(F.nullif(F.when(told.rlike(r"\A[\s\p{Cc}]*[+-]?[0-9]+[\s\p{Cc}]*\z"), told.try_cast("int")), F.lit(0)), F.lit(1))


def render(context: Column, rules: tuple[str, ...] = RULES, verse: str = VERSE_RULE) -> Column:
    """The block of a context struct: fixed rules, then a line for each field that is filled. The struct, often a parsed
    answer, is computed once however many fields it has."""
    return let(context, lambda c: let(pages_per_image(c), lambda n: block_of(c, n, rules, verse)))


def block_of(c: Column, n: Column, rules: tuple[str, ...], verse: str) -> Column:
    rtl = F.lower(F.trim(F.coalesce(filled(c["lang"]), F.lit("vi")))) == "ja"
    imprint = F.concat_ws(", ", filled(c["publisher"]), filled(c["year"]))
    book = F.concat(F.lit("Sách: "), c["title"], F.coalesce(F.concat(F.lit(" — "), filled(c["author"])), F.lit("")), F.coalesce(F.concat(F.lit(" (dịch: "), filled(c["translator"]), F.lit(")")), F.lit("")), F.when(imprint != "", F.concat(F.lit(" ("), imprint, F.lit(")"))).otherwise(""))
    order = F.when(rtl, F.concat(F.lit("Double pages, right to left: "), n.cast("string"), F.lit(" pages in each image, the right one first."))).otherwise(F.concat(F.lit("Double pages, left to right: "), n.cast("string"), F.lit(" pages in each image, the left one first.")))
    toc = F.transform(F.filter(c["table_of_contents"], lambda t: filled(t["title"]).isNotNull()), lambda t: F.concat(t["title"], F.lit(" tr."), F.coalesce(t["page"].cast("string"), F.lit("None"))))
    names = F.transform(F.filter(F.slice(c["proper_names"], 1, NAME_CAP), lambda x: filled(x["canonical"]).isNotNull()), lambda x: F.concat(F.coalesce(x["seen"], F.lit("None")), F.lit("→"), x["canonical"]))
    some = lambda name: F.filter(c[name], lambda x: filled(x).isNotNull())
    labelled = lambda label, name: F.concat(F.lit(label), filled(c[name]))
    return F.concat_ws(
        "\n", F.lit(HEAD), *map(F.lit, rules), F.when(F.lower(F.trim(c["content_type"])).isin("verse", "mixed"), F.lit(verse)), F.when(filled(c["title"]).isNotNull(), book),
        F.concat(F.lit(PER_IMAGE), n.cast("string")), F.when(n >= 2, order), listed(TOC, toc, "; "), listed(NAMES, names, ", "), listed(TERMS, some("terminology"), ", "),
        labelled(LAYOUT, "layout_notes"), labelled(NOTES, "footnote_convention"), listed(PITFALLS, some("ocr_pitfalls"), "; "))


def counts(c: Column) -> Column:
    size = lambda name: F.greatest(F.size(F.coalesce(c[name], F.array())), F.lit(0))
    return F.struct(size("table_of_contents").alias("toc"), size("proper_names").alias("names"))


def saved(contexts: DataFrame, generated_by: str) -> DataFrame:
    """contexts (book, context CONTEXT) as they are kept: book, json (with what made it), block (the rendered text)."""
    held = contexts.select("book", F.explode(F.array("context")).alias("context"))  # once, not in each of its fields
    whole = F.struct("context.*", F.lit(generated_by).alias("_generated_by"))
    return held.select("book", "context", F.explode(F.array(F.to_json(whole))).alias("json")).select("book", "json", render(F.col("context")).alias("block"))


def loaded(rows: DataFrame) -> DataFrame:
    """book, context of saved() rows; a damaged document, or one without a title, is no context."""
    return rows.select("book", F.explode(F.array(parse(F.col("json")))).alias("context")).where("context is not null")


def metadata(document: Column, slug: Column) -> Column:
    """struct title, author, lang, year of a book's metadata document; what it lacks, holds empty, or cannot be read for
    damage takes its default: the slug, '', 'vi' and ''. A number counts as its digits."""
    got = F.from_json(document, "title string, author string, lang string, year string")
    value = lambda name, default: F.coalesce(filled(got[name]), default).alias(name)
    return F.struct(value("title", slug), value("author", F.lit("")), value("lang", F.lit("vi")), value("year", F.lit("")))


def cover_page(answer: Column, pages: Column) -> Column:
    """The page that an answer names as the cover, if there is such a page."""
    n = F.get_json_object(json_object(answer), "$.cover_page").try_cast("int")
    return F.when(n.between(1, pages), n)


def safe_reason(answer: Column, most: int = 200) -> Column:
    return F.substring(F.coalesce(F.get_json_object(json_object(answer), "$.reason"), answer), 1, most)


def clamped_cover(index: Column, pages: Column) -> Column:
    return F.when(index.between(1, pages), index).otherwise(F.lit(1))
