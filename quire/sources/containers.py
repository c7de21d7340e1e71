"""Containers as tables: zip members, PDB records, scans of a folder."""

from __future__ import annotations

import fnmatch
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import files
from quire.functions.text import natural_key

MIN_RECORD = 1000
#: Members that a task hands on together.
MEMBERS_AT_ONCE = 64


def scan_images(spark: SparkSession, folder: str, patterns: str = "*.png,*.jpg,*.jpeg,*.heic,*.heif") -> DataFrame:
    """Files of a folder that match one of the comma-separated patterns, each once. Hidden names are never listed."""
    globs = ",".join(p.strip() for p in patterns.split(",") if p.strip())
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{globs}}}").load(folder)
    name = files.base_name(F.col("path"))
    return found.select("path", name.alias("name"), files.stem(name).alias("stem"), files.extension(name).alias("ext"), F.col("length").alias("size"), "content").where(~files.is_sidecar(F.col("name")))


def zip_members(archives: DataFrame, keys: list[str], content: str = "content", mark_empty: bool = False, wanted: str = "*") -> DataFrame:
    """A row for each member: keys, pos, name, stored, crc_ok, content. What is no zip has no rows or, with mark_empty,
    like a zip without members one row of nulls. wanted tells by comma-separated patterns of names of which members the
    bytes are handed on; the others are checked only."""
    patterns = wanted.split(",")
    kinds = ", ".join(f"`{k}` {archives.schema[k].dataType.simpleString()}" for k in keys)

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for part in parts:
            for row in part.itertuples(index=False):
                key = {k: getattr(row, k) for k in keys}
                try:
                    z = zipfile.ZipFile(io.BytesIO(getattr(row, content) or b""))
                    listed = [(pos, info) for pos, info in enumerate(z.infolist()) if not info.is_dir()]
                except zipfile.BadZipFile:
                    listed = []
                if mark_empty and not listed:
                    yield pd.DataFrame([key | {"pos": None, "name": None, "stored": None, "crc_ok": None, "content": None}])
                for pos, info in listed:
                    try:
                        data, ok = z.read(info), True
                    except (zipfile.BadZipFile, zlib.error, EOFError):
                        data, ok = b"", False
                    held.append(key | {"pos": pos, "name": info.filename, "stored": info.compress_type == zipfile.ZIP_STORED, "crc_ok": ok, "content": data if any(fnmatch.fnmatchcase(info.filename, p) for p in patterns) else None})
                    if len(held) == MEMBERS_AT_ONCE:
                        yield pd.DataFrame(held)
                        held = []
        if held:
            yield pd.DataFrame(held)

    return archives.select(*keys, content).mapInPandas(unpack, f"{kinds}, pos int, name string, stored boolean, crc_ok boolean, content binary")


def archived_images(archives: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The images of archives, numbered in natural order. A member that would leave the archive's folder is an error."""
    return numbered_images(zip_members(archives, keys, content), keys)


def numbered_images(members: DataFrame, keys: list[str]) -> DataFrame:
    """The images among members (keys, name, ...) as archived_images() tells them."""
    guarded = members.withColumn("name", F.when(files.escapes(F.col("name")), F.raise_error(F.concat(F.lit("member leaves the archive: "), "name"))).otherwise(F.col("name")))
    images = guarded.where(files.is_archived_image(F.col("name"))).withColumn("stem", files.stem(F.col("name"))).withColumn("ext", files.extension(F.col("name")))
    return images.withColumn("page_no", F.row_number().over(Window.partitionBy(*keys).orderBy(natural_key(F.col("stem")), "stem", "ext")))


def pdb_records(containers: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, record_no, record, error. Offsets are big-endian at 78 + 8 i; a record ends where the next begins."""
    c = F.col(content)
    n = files.uint(c, 76, 2)
    base = containers.select(*keys, content, F.length(c).alias("size_"), n.alias("n_"))
    short = (F.col("size_") < 78) | (78 + 8 * F.col("n_") > F.col("size_"))
    at = F.transform(F.sequence(F.lit(0), F.col("n_") - 1), lambda i: F.conv(F.hex(F.substring(c, (79 + 8 * i).cast("int"), F.lit(4))), 16, 10).cast("long"))
    offsets = base.withColumn("at_", F.when(~short & (F.col("n_") > 0), at)).withColumn("bad_", short | F.exists("at_", lambda x: x > F.col("size_")))
    good = offsets.where(~F.coalesce("bad_", F.lit(True)) | (F.col("n_") == 0)).withColumn("ends_", F.concat(F.slice("at_", 2, 1 << 20), F.array("size_")))
    rows = good.select(*keys, content, F.posexplode(F.arrays_zip("at_", "ends_")).alias("record_no", "p"))
    cut = F.substring(c, (F.col("p.at_") + 1).cast("int"), F.greatest(F.col("p.ends_") - F.col("p.at_"), F.lit(0)).cast("int"))
    damaged = offsets.where(F.coalesce("bad_", F.lit(True)) & ~F.coalesce(F.col("n_") == 0, F.lit(False)))
    return rows.select(*keys, "record_no", cut.alias("record"), F.lit(None).cast("string").alias("error")).union(damaged.select(*keys, F.lit(None).cast("int"), F.lit(None).cast("binary"), F.lit("damaged container")))


def pdb_images(containers: DataFrame, keys: list[str], content: str = "content", least: int = MIN_RECORD) -> DataFrame:
    """Records that hold an image of more than `least` bytes, numbered in the order of the records."""
    r = pdb_records(containers, keys, content).withColumn("ext", files.sniff(F.col("record"))).where(F.col("ext").isin("jpg", "png", "gif") & (F.length("record") > least))
    return r.withColumn("page_no", F.row_number().over(Window.partitionBy(*keys).orderBy("record_no")))


def without_pages(archives: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of archives that gave no page, which is an error of the input."""
    return archives.select(*keys).join(pages.select(*keys), keys, "left_anti")
