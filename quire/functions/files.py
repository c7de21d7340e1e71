"""Scalar functions on names, URLs and bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that systems leave beside scans, and the extensions of each reader.
SIDECARS = (".DS_Store", "Thumbs.db")
IMAGE_EXTS = ("jpg", "jpeg", "png", "gif", "heic", "heif")
IMPORT_EXTS = ("png", "jpg", "jpeg", "heic", "heif")
MOBI_EXTS, ARCHIVE_EXTS = ("mobi", "azw3"), ("cbz", "cbr", "zip")
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
DRIVE_HOST = "drive.google.com"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def is_sidecar(name: Column) -> Column:
    return name.startswith("._") | name.isin(*SIDECARS)


def is_archived_image(path: Column) -> Column:
    """An image member of an archive: not below __MACOSX, no dot file, a known extension."""
    return ~F.array_contains(F.split(path, "/"), "__MACOSX") & ~base_name(path).startswith(".") & extension(path).isin(*IMAGE_EXTS)


def escapes(path: Column) -> Column:
    """Whether a member's path leaves the folder it is unpacked to."""
    return path.startswith("/") | path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") | path.rlike(r"^[A-Za-z]:")


def media_type(ext: Column) -> Column:
    out = F.lit("image/jpeg")
    for e, m in MEDIA_TYPES.items():
        out = F.when(F.lower(ext) == e, F.lit(m)).otherwise(out)
    return out


def upload_mime(ext: Column) -> Column:
    return F.when(F.lower(ext).isin("jpg", "jpeg"), "image/jpeg").when(F.lower(ext) == "webp", "image/webp").otherwise("image/png")


def reader_for(path: Column) -> Column:
    """Which reader takes an input: drive, mobi, archive, folder; null where none does."""
    ext = extension(path)
    return F.when(path.rlike("^https?://"), F.lit("drive")).when(ext.isin(*MOBI_EXTS), "mobi").when(ext.isin(*ARCHIVE_EXTS), "archive").when(ext == "", "folder")


def is_drive(url: Column) -> Column:
    """An http(s) URL whose host part ends with the drive's host."""
    return F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1).endswith(DRIVE_HOST)


def is_drive_folder(url: Column) -> Column:
    """A drive link that names a folder, or has an id in its query without naming a file."""
    by_id = url.rlike(r"\?(?:[^#]*&)?id=[^&#]") & ~url.contains("/file/d/")
    return is_drive(url) & (url.contains("/folders/") | by_id)


def drive_id(url: Column) -> Column:
    pick = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(pick(r"/file/d/([\w-]+)"), pick(r"/folders/([\w-]+)"), pick(r"[?&]id=([^&#]+)"))


def confirm_token(html: Column) -> Column:
    pick = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return F.coalesce(pick(r'name="confirm"\s+value="([\w-]+)"'), pick(r"confirm=([\w-]+)"))


def listed_files(html: Column) -> Column:
    """Ids of the files that a folder's page links, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"/file/d/([\w-]+)"), F.lit(1)))


def uint(content: Column, at: int, size: int, little: bool = False) -> Column:
    """The unsigned number at 0-based offset `at`; null beyond the end."""
    h = F.hex(F.substring(content, at + 1, size))
    if little:
        h = F.concat(*(F.substring(h, i, 2) for i in range(2 * size - 1, 0, -2)))
    return F.when(F.length(content) >= at + size, F.conv(h, 16, 10).cast("long"))


def sniff(content: Column) -> Column:
    """File type by its first bytes."""
    starts = lambda h: F.hex(F.substring(content, 1, len(h) // 2)) == h
    kind = F.when(starts("25504446"), "pdf").when(starts("FFD8FF"), "jpg").when(starts("89504E470D0A1A0A"), "png")
    kind = kind.when(starts("474946383761") | starts("474946383961"), "gif").when(starts("504B0304"), "zip").when(starts("526172211A07"), "rar")
    return kind.when(F.hex(F.substring(content, 61, 4)).isin("4D4F4249", "424F4F4B"), "mobi").otherwise("unknown")


def is_payload(content: Column) -> Column:
    """Whether bytes are of a known type; a page that stands in for a file is not."""
    return F.coalesce(sniff(content) != "unknown", F.lit(False))


@F.pandas_udf(T.StructType([T.StructField("w", T.IntegerType()), T.StructField("h", T.IntegerType())]))
def jpeg_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the first frame header: a walk over markers, which no built-in expresses."""

    def walk(b: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while b and at + 9 <= len(b) and b[at] == 0xFF:
            marker = b[at + 1]
            if marker == 0xFF or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            else:
                at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        return None, None

    return pd.DataFrame([walk(b) for b in content], columns=["w", "h"]).astype("Int32")


def image_size(content: Column) -> Column:
    """struct<w, h> of a PNG, GIF or JPEG; null fields for anything else."""
    kind, pair = sniff(content), lambda w, h: F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    png, gif = pair(uint(content, 16, 4), uint(content, 20, 4)), pair(uint(content, 6, 2, True), uint(content, 8, 2, True))
    return F.when(kind == "png", png).when(kind == "gif", gif).otherwise(jpeg_size(F.when(kind == "jpg", content)))
