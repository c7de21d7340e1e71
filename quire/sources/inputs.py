"""Folders of mixed inputs as pages: each folder is read by the reader that its files ask for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import files, text
from quire.operators.pages import classify_folders
from quire.sources import containers, convert


def routed(inputs: DataFrame) -> DataFrame:
    """inputs (folder, name, content) with file_type and the route of their folder."""
    typed = inputs.withColumn("file_type", files.sniff(F.col("content")))
    routes = classify_folders(typed.select("folder", "file_type")).select("folder", "route", "histogram")
    return typed.join(routes, "folder")


def read_inputs(inputs: DataFrame, pdf_backends: Sequence[convert.Pages] = convert.PDF_BACKENDS) -> DataFrame:
    """folder, route, page_no, ext, content, error: the pages of each folder, images as they are, or the pages of the one
    archive, container or PDF that it holds. A folder of mixed files, or of RAR without a reader, and one without any
    page has one row with an error."""
    r = routed(inputs).where("route <> 'mixed'")
    own = lambda kind: r.where(F.col("route") == kind).select("folder", "content")
    page = lambda df, ext: df.select("folder", "page_no", ext.alias("ext"), "content")
    stem = files.stem(F.col("name"))
    images = r.where("route = 'images'").withColumn("page_no", F.row_number().over(Window.partitionBy("folder").orderBy(text.natural_key(stem), stem, files.extension(F.col("name")))))
    found = page(images, F.col("file_type"))
    found = found.union(page(containers.archived_images(own("zip"), ["folder"]), F.col("ext")))
    found = found.union(page(containers.pdb_images(own("mobi"), ["folder"]).drop("content").withColumnRenamed("record", "content"), F.col("ext")))
    found = found.union(page(convert.pdf_pages(own("pdf"), ["folder"], backends=pdf_backends).where("error is null"), F.lit("png")))
    folders = classify_folders(inputs.select("folder", files.sniff(F.col("content")).alias("file_type")))
    error = F.when(F.col("route") == "mixed", F.concat(F.lit("mixed: "), "histogram")).when(F.col("page_no").isNull(), F.lit("no pages"))
    return folders.join(found, "folder", "left").select("folder", "route", "page_no", "ext", "content", error.alias("error"))
