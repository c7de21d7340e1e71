"""Unicode normal forms as Spark expressions, by tables that are made from Python's character data."""

from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed by the standard: where Hangul syllables and their parts begin, and how many parts of each kind there are.
SYLLABLES, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7
N_LEADS, N_VOWELS, N_TAILS = 19, 21, 28
N_SYLLABLES = N_LEADS * N_VOWELS * N_TAILS


def is_syllable(cp: int) -> bool:
    return SYLLABLES <= cp < SYLLABLES + N_SYLLABLES


ALL = [chr(cp) for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp <= 0xDFFF and unicodedata.category(chr(cp)) not in ("Cn", "Co")]
#: What a character is taken apart to, whole; its class, if it moves among marks; and what two make together.
APART = {c: d for c in ALL if not is_syllable(ord(c)) and (d := unicodedata.normalize("NFD", c)) != c}
CLASSES = {c: n for c in ALL if (n := unicodedata.combining(c))}
TOGETHER = {}
for c in APART:
    parts = unicodedata.decomposition(c).split()
    if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:
        TOGETHER[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = c
#: Characters without which a text is composed already.
OPEN = {*CLASSES, *(pair[1:] for pair in TOGETHER), *(c for c in APART if unicodedata.normalize("NFC", c) != c), *map(chr, range(VOWELS, VOWELS + N_VOWELS)), *map(chr, range(TAILS + 1, TAILS + N_TAILS))}


def ranges(chars: set[str]) -> str:
    """A pattern of one of the characters."""
    out, codes = [], sorted(map(ord, chars))
    for i, cp in enumerate(codes):
        if not i or cp != codes[i - 1] + 1:
            out.append([cp, cp])
        out[-1][1] = cp
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


OPEN_PATTERN = ranges(OPEN)


def table(entries: dict, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), f"map<string, {kind}>")


def character(cp: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 4, "0")), "UTF-16BE")


def taken_apart(text: Column) -> Column:
    """The characters of the canonical decomposition, not yet in order."""
    n = lambda c: F.ascii(c) - SYLLABLES
    lead, vowel, tail = (lambda c: character(F.floor(n(c) / (N_VOWELS * N_TAILS)) + LEADS)), (lambda c: character(F.floor(n(c) % (N_VOWELS * N_TAILS) / N_TAILS) + VOWELS)), (lambda c: F.when(n(c) % N_TAILS > 0, character(n(c) % N_TAILS + TAILS)).otherwise(""))
    parts = lambda c: F.when(n(c).between(0, N_SYLLABLES - 1), F.concat(lead(c), vowel(c), tail(c))).otherwise(F.coalesce(F.element_at(table(APART, "string"), c), c))
    return F.split(F.array_join(F.transform(F.split(text, ""), parts), ""), "")


def in_order(chars: Column) -> Column:
    """Characters as structs c, cls, the marks behind each base by their classes."""
    classed = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), F.coalesce(F.element_at(table(CLASSES, "int"), c), F.lit(0)).alias("cls"), i.alias("i")))
    base = lambda marks, x: F.coalesce(F.array_max(F.transform(F.filter(marks, lambda y: (y["cls"] == 0) & (y["i"] <= x["i"])), lambda y: y["i"])), F.lit(-1))
    keyed = F.transform(F.array(classed), lambda xs: F.array_sort(F.transform(xs, lambda x: F.struct(base(xs, x).alias("base"), x["cls"].alias("cls"), x["i"].alias("i"), x["c"].alias("c")))))
    return keyed[0]


def put_together(marks: Column) -> Column:
    """The canonical composition of characters in order."""
    kind = "struct<done: string, base: string, marks: string, cls: int>"
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("cls")).cast(kind)
    state = lambda done, base, marks, cls: F.struct(done.alias("done"), base.alias("base"), marks.alias("marks"), cls.alias("cls")).cast(kind)

    def hangul(a: Column, b: Column) -> Column:
        lead, vowel, tail, whole = F.ascii(a) - LEADS, F.ascii(b) - VOWELS, F.ascii(b) - TAILS, F.ascii(a) - SYLLABLES
        two = lead.between(0, N_LEADS - 1) & vowel.between(0, N_VOWELS - 1)
        three = whole.between(0, N_SYLLABLES - 1) & (whole % N_TAILS == 0) & tail.between(1, N_TAILS - 1)
        return F.when(two, character((lead * N_VOWELS + vowel) * N_TAILS + SYLLABLES)).when(three, character(F.ascii(a) + tail))

    def step(s: Column, x: Column) -> Column:
        free = (s["base"] != "") & ((s["marks"] == "") | (s["cls"] < x["cls"]))
        pair = F.when(free, F.coalesce(F.element_at(table(TOGETHER, "string"), F.concat(s["base"], x["c"])), hangul(s["base"], x["c"])))
        new = state(F.concat(s["done"], s["base"], s["marks"]), x["c"], F.lit(""), F.lit(0))
        kept = state(s["done"], s["base"], F.concat(s["marks"], x["c"]), x["cls"])
        return F.when(pair.isNotNull(), state(s["done"], pair, s["marks"], s["cls"])).when(x["cls"] == 0, new).otherwise(kept)

    return F.aggregate(marks, start, step, lambda s: F.concat(s["done"], s["base"], s["marks"]))


def nfc(text: Column) -> Column:
    """The canonical composition. Texts that need none, nearly all, are only looked through; others are short (titles,
    headings), for the work grows with the square of their length."""
    return F.when(text.rlike(OPEN_PATTERN), put_together(in_order(taken_apart(text)))).otherwise(text)


# ASCII letters and digits that characters are made of by compatibility: one, or several.
PLAIN = {c: a for c in ALL if ord(c) > 127 and (a := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())} | {"đ": "d", "Đ": "D"}
ONE = {c: a for c, a in PLAIN.items() if len(a) == 1}
SEVERAL = {c: a for c, a in PLAIN.items() if len(a) > 1}
SEVERAL_PATTERN = ranges(set(SEVERAL))


def ascii_only(text: Column) -> Column:
    """What is left of the compatibility decomposition of a text, of any length, in ASCII; đ counts as d."""
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table(SEVERAL, "string"), c), c)), "")
    whole = F.when(text.rlike(SEVERAL_PATTERN), spelled).otherwise(text)
    return F.regexp_replace(F.translate(whole, "".join(ONE), "".join(ONE.values())), r"[^\x00-\x7F]", "")
