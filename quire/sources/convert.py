"""Conversions that need an external program: HEIC images, PDF pages, RAR members. Programs are run by the tasks.

A backend is a function on bytes that raises if it fails; the first one that works is taken. The default backends pipe
bytes through a program, so no task writes files. Without any of the programs a row gets an error, not a page.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Convert = Callable[[bytes], bytes]
Pages = Callable[[bytes, int], list[bytes]]
Members = Callable[[bytes], list[tuple[str, bytes]]]
SECONDS = 300


def piped(*command: str) -> Convert:
    """A backend that sends the bytes through a program."""

    def run(data: bytes) -> bytes:
        out = subprocess.run(command, input=data, capture_output=True, timeout=SECONDS, check=True).stdout
        if not out:
            raise ValueError(f"{command[0]} gave nothing")
        return out

    return run


def pdftoppm(data: bytes, dpi: int) -> list[bytes]:
    """Pages one by one, until there is none."""
    pages: list[bytes] = []
    while True:
        n = str(len(pages) + 1)
        done = subprocess.run(["pdftoppm", "-png", "-r", str(dpi), "-f", n, "-l", n, "-"], input=data, capture_output=True, timeout=SECONDS)
        if done.returncode or not done.stdout:
            if pages:
                return pages
            raise ValueError(done.stderr.decode(errors="replace")[:200] or "no pages")
        pages.append(done.stdout)


HEIC_BACKENDS: tuple[Convert, ...] = (piped("magick", "heic:-", "jpg:-"), piped("convert", "heic:-", "jpg:-"))
PDF_BACKENDS: tuple[Pages, ...] = (pdftoppm,)


def first_that_works(backends: Sequence[Callable], *args) -> tuple[object, str | None]:
    """(result, None) of the first backend that works, or (None, what each of them said)."""
    said = []
    for b in backends:
        try:
            return b(*args), None
        except (OSError, ValueError, subprocess.SubprocessError) as e:
            said.append(f"{getattr(b, '__name__', 'backend')}: {e}"[:200])
    return None, "; ".join(said) or "no backend"


def heic_to_jpg(images: DataFrame, backends: Sequence[Convert] = HEIC_BACKENDS) -> DataFrame:
    """images (ext, content, ...) with HEIC ones converted, ext jpg, and a column error; others as they are.

    A null or damaged image has no content and an error. Only HEIC images pass through Python.
    """
    heic = F.coalesce(F.lower("ext").isin("heic", "heif"), F.lit(False))
    marked = images.withColumn("error", F.lit(None).cast("string"))
    schema = marked.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [first_that_works(backends, bytes(c)) if c is not None else (None, "no content") for c in part["content"]]
            yield part.assign(content=[m[0] for m in made], error=[m[1] for m in made], ext="jpg")

    return marked.where(~heic).union(marked.where(heic).mapInPandas(run, schema))


def pdf_pages(pdfs: DataFrame, keys: list[str], dpi: int = 150, backends: Sequence[Pages] = PDF_BACKENDS) -> DataFrame:
    """keys, page_no, content, error: a row for each page of each PDF, in order, or one with an error."""
    kinds = ", ".join(f"`{k}` {pdfs.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                key = {k: row[k] for k in keys}
                found, error = first_that_works(backends, bytes(row["content"] or b""), dpi)
                if error:
                    yield pd.DataFrame([key | {"page_no": None, "content": None, "error": error}]).astype({"page_no": "Int32"})
                for n, page in enumerate(found or [], 1):
                    yield pd.DataFrame([key | {"page_no": n, "content": page, "error": None}])

    return pdfs.select(*keys, "content").mapInPandas(run, f"{kinds}, page_no int, content binary, error string")


def rar_images(archives: DataFrame, keys: list[str], unpack: Members) -> DataFrame:
    """keys, name, content, page_no: the images of RAR archives in natural order. `unpack` opens an archive; a member
    that would leave its folder is an error, as it is in zip archives."""
    from quire.functions import files
    from quire.functions.text import natural_key

    kinds = ", ".join(f"`{k}` {archives.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                for name, data in unpack(bytes(row["content"] or b"")):
                    yield pd.DataFrame([{k: row[k] for k in keys} | {"name": name, "content": data}])

    m = archives.select(*keys, "content").mapInPandas(run, f"{kinds}, name string, content binary")
    m = m.withColumn("name", F.when(files.escapes(F.col("name")), F.raise_error(F.concat(F.lit("member leaves the archive: "), "name"))).otherwise(F.col("name")))
    images = m.where(files.is_archived_image(F.col("name")))
    stem = files.stem(F.col("name"))
    return images.withColumn("page_no", F.row_number().over(Window.partitionBy(*keys).orderBy(natural_key(stem), stem, files.extension(F.col("name")))))
