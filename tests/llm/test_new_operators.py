"""Fill-in-middle, contamination and hard negatives on awkward rows, beside brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import block_products, decontaminate, fill_middle

AWKWARD = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "a\r\nb", "<P>\nx", "x<S>", "<<M>>\n", "<\nP>\nx", "naïve\n𝔘𝔫𝔦\n日本\n", "\x00\n\x00", " \t\n", "w " * 3000 + "\n" + "x" * 100_000, "l\n" * 5000]


def brute_fim(text, draws, rate=100, spm=50, marks=("<P>", "<S>", "<M>"), units=lambda t: re.findall(r"[^\n]*\n|[^\n]+", t)):
    text = text or ""
    u = units(text)
    h = [int(draws[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    out = marks[1] + suf + marks[0] + pre + marks[2] + mid if h[3] % 100 < spm else marks[0] + pre + marks[1] + suf + marks[2] + mid
    return len(u), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


@pytest.mark.parametrize(("options", "units"), [({}, None), ({"seed": 3, "rate": 60, "spm_rate": 0}, None), ({"marks": ("<|pre|>", "<|suf|>", "<|mid|>"), "unit": "words"}, lambda t: re.findall(r"^[\x09-\x0D ]+|[^\x09-\x0D ]+[\x09-\x0D ]*", t)), ({"unit": "characters"}, list)])
def test_fill_middle_like_brute_force(spark, options, units):
    rows = [(i, t, "x") for i, t in enumerate(AWKWARD * 6)] + [(None, "a\nb\n", "y"), (3, "\n\n\n", "z"), (3, "\n\n\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(5)
    made = fill_middle.fill_in_middle(docs, **options)
    marks = options.get("marks", fill_middle.MARKS)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    want = []
    for i, t, _ in rows:
        d = hashlib.sha256(f"{options.get('seed', 7)}:{'' if i is None else i}".encode()).hexdigest()
        more = {"units": units} if units else {}
        want.append((i, *brute_fim(t, d, options.get("rate", 100), options.get("spm_rate", 50), marks, **more), t or ""))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    forms = {r.form for r in got}
    assert forms == ({"plain", "psm"} if options.get("spm_rate") == 0 else {"plain", "psm", "spm"})


def test_fill_middle_without_rows_and_with_bad_options(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.digests(none).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "><S", "<M>"), ("<P>", "x<P>x", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(none, marks=marks)
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(none, unit="pages")


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n<>PSM𝔘é", max_size=40), st.tuples(*[st.integers(0, 2**32 - 1)] * 4))
def test_units_are_the_lines_and_forms_can_be_undone(text, draws):
    points = fill_middle.code_points(text)
    ends = [0, *fill_middle.unit_ends(points, "lines")]
    assert [text[a:b] for a, b in zip(ends, ends[1:])] == re.findall(r"[^\n]*\n|[^\n]+", text)
    n, form, p, m, out = fill_middle.transformed(text, draws, "lines", 100, 50, fill_middle.MARKS)
    if form == "psm":
        pre, rest = out[3:].split("<S>")
        suf, mid = rest.split("<M>")
    elif form == "spm":
        suf, rest = out[3:].split("<P>")
        pre, mid = rest.split("<M>")
    else:
        pre, mid, suf = out, "", ""
    assert pre + mid + suf == text and (form == "plain" or (len(pre), len(mid)) == (p, m))


def brute_words(text):
    return [(m.group().translate({c: c + 32 for c in range(65, 91)}), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_contamination(text, items, window=10):
    words = brute_words(text)
    hit, met = [False] * len(words), set()
    for item, t in items:
        w = [x[0] for x in brute_words(t)]
        for pattern in {tuple(w[i : i + window]) for i in range(max(len(w) - window + 1, 1))} if w else ():
            for i in range(len(words) - len(pattern) + 1):
                if tuple(x[0] for x in words[i : i + len(pattern)]) == pattern:
                    hit[i : i + len(pattern)] = [True] * len(pattern)
                    met |= {item} if item is not None else set()
    spans = []
    for i, h in enumerate(hit):
        if h and i and hit[i - 1]:
            spans[-1][1] = words[i][2]
        elif h:
            spans.append([words[i][1], words[i][2]])
    return len(words), sum(hit), [tuple(s) for s in spans], sorted(str(i) for i in met)


@pytest.mark.parametrize("part_bytes", [1 << 20, 400])
def test_contamination_like_brute_force(spark, part_bytes):
    rnd = random.Random(5)
    vocabulary = ["a", "Be", "cé", "Ünd", "d1", "日本", "𝔘", "x"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ", ", "\n", "--", " \x00"]) for _ in range(n))
    long = [text(rnd.randint(11, 25)) for _ in range(12)]
    items = [(i, t) for i, t in enumerate(long)] + [(20, None), (21, ""), (22, ".,- "), (23, "a Be"), (24, "D1"), (None, long[3]), (25, long[3].upper()), (25, long[4]), (25, long[4]), (7, "cé cé cé")]
    docs = [(i, rnd.choice(["", "z "]) + "".join(rnd.choice([text(rnd.randint(1, 8)), rnd.choice(long), "zz "]) for _ in range(rnd.randint(0, 5)))) for i in range(60)]
    docs += [(None, long[0]), (100, None), (101, ""), (102, "!?"), (3, docs[3][1]), (103, long[1] * 200), (104, "q" * 300_000 + " " + long[2]), (105, "aBe a-be"), (106, "a.BE")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int").repartition(4)
    bench = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, words int")
    got = decontaminate.contamination(frame, bench, part_bytes=part_bytes).collect()
    want = [(i, *brute_contamination(t, items)) for i, t in docs]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"])) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) > 20


def test_contamination_of_empty_tables_and_several_fields(spark):
    docs = spark.createDataFrame([(1, "Why is it so? Because of rain."), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "why is it SO", "of rain")], "item_id string, question string, answer string")
    none = bench.where("false").select("item_id", F.col("question").alias("text"))
    assert sorted(map(tuple, decontaminate.contamination(docs, none).collect())) == [(1, 7, 0, [], []), (2, 0, 0, [], [])]
    told = decontaminate.contamination(docs, bench, fields=("question", "answer")).where("doc_id = 1").first()
    assert (told.n_hit, [tuple(s) for s in told.spans], told["items"]) == (6, [(0, 12), (22, 29)], ["q"])
    assert decontaminate.digests(docs.where("false"), bench, fields=("question", "answer")).collect() == []
    empty = decontaminate.digests(docs, none).where("doc_id = 2").first()
    assert (empty.n_items, empty.items_sha256, empty.contaminated) == (0, hashlib.sha256(b"").hexdigest(), False)


def brute_negatives(rows, is_anchor, positives, negatives, low, high, scale=256):
    able = []
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        able.append((i, tuple(int(np.floor(scale * float(x))) for x in v), label))
    out, able = [], sorted(set(able))
    for i, v, label in able:
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in able if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            held = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(held)]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "chunk"), [((1024, 256), 32), ((7, 3), 2)])
def test_hard_negatives_like_brute_force(spark, blocks, chunk):
    rnd = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rnd.normal(size=5).astype(np.float32).round(1)], int(rnd.integers(0, 4))) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.25, 0.0, 1.0], 1 + i % 2) for i in range(200, 240)]  # ties
    rows += [(rows[5][0], rows[5][1], rows[5][2]), (10, [1.0, 0.0, 0.0, 0.0, 2.0], 9), (300, None, 1), (301, [1.0, None, 1.0, 1.0, 1.0], 1), (302, [float("nan")] * 5, 2), (303, [float("inf")] * 5, 2), (304, [1.0] * 5, None), (None, [1.0] * 5, 1), (310, [0.0] * 5, 2), (320, [], 1), (330, [1.0, 2.0], 1), (331, [1.0, 2.5], 1), (332, [0.5, 1.0], 2)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, rank int").repartition(6)
    got = block_products.hard_negatives(frame, F.col("vec_id") % 10 == 0, 3, 4, blocks=blocks, chunk=chunk).collect()
    want = brute_negatives(rows, lambda i: i % 10 == 0, 3, 4, 30, 90)
    assert sorted(map(tuple, got)) == want and len(want) > 100
    assert block_products.hard_negatives(frame.where("false"), F.col("vec_id") % 10 == 0).collect() == []
    assert block_products.hard_negatives(frame, F.lit(False)).collect() == []


def test_products_are_exact_for_large_numbers():
    a = np.array([[1 << 30, 3], [-(1 << 30), 5]])
    b = np.array([[(1 << 30) + 1, 7]])
    assert block_products.product(a, b).tolist() == [[(1 << 60) + (1 << 30) + 21], [-(1 << 60) - (1 << 30) + 35]]
    assert block_products.product(a[:, :0], b[:, :0]).tolist() == [[0], [0]]
