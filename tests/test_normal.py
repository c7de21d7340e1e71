"""Normal forms beside Python's, on every assigned character and on mixtures."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quire.functions import normal, text
from quire.operators import lines


def slug(s):
    plain = s.translate({ord("đ"): "d", ord("Đ"): "D"})
    return re.sub(r"[^A-Za-z0-9]+", "-", unicodedata.normalize("NFKD", plain).encode("ascii", "ignore").decode()).strip("-").lower() or "book"


def test_every_assigned_character(spark):
    df = spark.createDataFrame([(c, f"a{c}") for c in normal.ALL], "c string, behind string").repartition(8)
    got = df.select("c", normal.nfc(F.col("c")).alias("n"), normal.nfc(F.col("behind")).alias("b")).collect()
    assert len(got) == len(normal.ALL) > 140_000
    assert [r.c for r in got if r.n != unicodedata.normalize("NFC", r.c) or r.b != unicodedata.normalize("NFC", "a" + r.c)] == []
    every = spark.createDataFrame([(c,) for c in normal.ALL], "c string").repartition(8).select("c", text.slugify("c").alias("s")).collect()
    assert [r.c for r in every if r.s != slug(r.c)] == []


def test_mixtures(spark):
    r = random.Random(1)
    marks, bases = sorted(normal.CLASSES), [*"aeiouAOUcdsń ", *sorted(normal.APART)[::40], "가", "ᄀ", "ᅡ", "ᆨ", "ᆧ", "𝅘𝅥"]
    texts = ["".join(r.choice(marks if r.random() < 0.6 else bases) for _ in range(r.randint(1, 9))) for _ in range(1500)] + ["", None, "Mục lục", "a" * 300 + "́", "̣́a", "ậ", "ậ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    for row in df.select("t", normal.nfc(F.col("t")).alias("n"), text.slugify("t").alias("s")).collect():
        assert row.n == (None if row.t is None else unicodedata.normalize("NFC", row.t)), ascii(row.t)
        assert row.s == slug(row.t or "")


def test_books_are_cleaned_whichever_way_names_are_written(spark):
    apart = lambda s: unicodedata.normalize("NFD", s)
    md = ["## Mục Lục\nentry 1\n\n## Đời thường\n\n## Nam Cao\n## Next\ntext\n## mục lục\nx\n# Part\ny\n", "## muc luc\nall\n", "no line end", "## Đời thường\nbody\n"]
    rows = [(f"{k}{i}", f(m), f("Đời thường"), [g("Nam Cao"), ""]) for i, m in enumerate(md) for k, f, g in (("a", apart, str), ("b", str, apart))]
    merged = spark.createDataFrame([(b, m) for b, m, _, _ in rows], "book string, md string")
    books = spark.createDataFrame([(b, t, a) for b, _, t, a in rows], "book string, title string, authors array<string>")
    got = {r.book: (unicodedata.normalize("NFC", r.md), r.removed, [unicodedata.normalize("NFC", d) for d in r.demoted]) for r in lines.clean_books(merged, books).collect()}
    want = [("Đời thường\n\nNam Cao\n## Next\ntext\n# Part\ny\n", 2, ["Đời thường", "Nam Cao"]), ("\n", 1, []), ("no line end\n", 0, []), ("## Đời thường\nbody\n", 0, [])]
    assert got == {f"{k}{i}": w for i, w in enumerate(want) for k in "ab"}
