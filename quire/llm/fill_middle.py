"""Fill-in-the-middle transformation: texts as arrays of code points, cut where the classes of neighbours say that a unit
ends, and put together again with the middle last."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import append_columns

SEED = 7
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and so many of these begin with their suffix.
RATE, SPM_RATE = 100, 50
NEWLINE = 10
BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)

#: Classes of code points, and whether a unit ends between a code point of the first class and one of the second.
UNITS: dict[str, tuple[Callable, Callable]] = {
    # A line with its \n; what follows the last \n is a line too.
    "lines": (lambda points: points == NEWLINE, lambda this, following: this),
    # A word with the blanks behind it; blanks that open the text are a unit.
    "words": (lambda points: np.isin(points, BLANKS), lambda this, following: this & ~following),
    "characters": (lambda points: points, lambda this, following: np.ones(len(this), bool)),
}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def as_text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def unit_ends(points: np.ndarray, unit: str) -> np.ndarray:
    """The number of code points up to the end of each unit, in order; the last is the length of the text."""
    if not len(points):
        return np.zeros(0, np.int64)
    kind, ends = UNITS[unit]
    kinds = kind(points)
    return np.append(np.flatnonzero(ends(kinds[:-1], kinds[1:])) + 1, len(points))


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart in any text that holds none of them, whatever it ends or begins with."""
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("marks must be three different texts, none empty")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b) - (a == b) + 1))):
                raise ValueError(f"mark {a!r} overlaps with mark {b!r}")


def transformed(text: str, draws: tuple[int, int, int, int], unit: str, rate: int, spm_rate: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, length of prefix and of middle in code points, output) of one text."""
    points = code_points(text)
    ends = unit_ends(points, unit)
    n = len(ends)
    if not n or any(m in text for m in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    upto = np.append(0, ends)
    a, b = int(upto[first]), int(upto[second])
    prefix, middle, suffix = as_text(points[:a]), as_text(points[a:b]), as_text(points[b:])
    p, s, m = marks
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    Cuts and forms are drawn from the SHA-256 of `seed:doc_id`, so reruns agree and repeated rows are treated alike; a
    null doc_id is drawn as if it were empty. A text that is empty or null (no units), holds a mark or is not drawn
    stays plain: its output is the text, its lengths are null. A unit is a line, a word or a character; prefix or middle
    may be empty. Whole texts are cut, of any length; an empty table gives no rows; other columns are not read.
    Nothing is shuffled.
    """
    check_marks(marks)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), digest.alias("drawn"))

    def make(texts: list[str], drawn: list[str]) -> list[tuple]:
        return [transformed(t, tuple(int(d[i : i + 8], 16) for i in (0, 8, 16, 24)), unit, rate, spm_rate, marks) for t, d in zip(texts, drawn)]

    names = [("n", "long", pa.int64()), ("form", "string", pa.string()), ("prefix_chars", "long", pa.int64()), ("middle_chars", "long", pa.int64()), ("output", "string", pa.string())]
    return append_columns(rows, ["text", "drawn"], make, names).select("doc_id", *(n for n, _, _ in names))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made from, whatever its cuts."""
    check_marks(marks)
    p, s, m = marks
    rest, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    behind = lambda c, mark: F.substring(c, F.lit(len(mark) + 1), F.length(c))
    psm = F.concat(behind(F.substring_index(rest, s, 1), p), middle, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), middle, behind(F.substring_index(rest, p, 1), s))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(docs: DataFrame, **options) -> DataFrame:
    """fill_in_middle() with the SHA-256 of each output and of the text that it and its form give back, in their stead."""
    marks = options.get("marks", MARKS)
    made = fill_in_middle(docs, **options)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))


DIGEST_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || CAST(doc_id AS VARCHAR)) AS hex FROM documents),
h AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM o
"""
