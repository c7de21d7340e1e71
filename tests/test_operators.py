"""Operators on small fixtures: containers, packages, contexts, attempts, recognition."""

import io
import random
import struct
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from quire.functions import files, markdown, text
from quire.operators import attempts, batch, context, cost, lines, packages, pages, summaries
from quire.sources import containers, convert
from quire.streaming import recognize


def png(w, h, size=0):
    return (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, h)).ljust(size, b"\0")


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", h, w) + b"\0" * 12 + b"\xff\xd9"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h)


def zip_of(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in names.items():
            z.writestr(n, b)
    return out.getvalue()


def pdb(records):
    at, offsets = 78 + 8 * len(records), []
    for r in records:
        offsets.append(at)
        at += len(r)
    return b"\0" * 76 + struct.pack(">H", len(records)) + b"".join(struct.pack(">II", o, 0) for o in offsets) + b"".join(records)


def test_types_and_sizes(spark):
    mobi = b"\0" * 60 + b"BOOKMOBI"
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([png(8, 9), jpeg(30, 40), gif(5, 6), b"%PDF-1", b"PK\3\4", b"Rar!\x1a\7\0", mobi, b""])], "i int, c binary")
    got = df.select("i", files.sniff(F.col("c")).alias("k"), files.image_size(F.col("c")).alias("s")).orderBy("i").collect()
    assert [r.k for r in got] == ["png", "jpg", "gif", "pdf", "zip", "rar", "mobi", "unknown"]
    assert [(r.s.w, r.s.h) for r in got[:3]] == [(8, 9), (30, 40), (5, 6)] and got[3].s.w is None


def test_archives(spark):
    good = zip_of({"b/p10.png": b"x", "b/p9.jpg": b"y", "__MACOSX/p1.png": b"", "b/._p2.png": b"", "t.txt": b""})
    df = spark.createDataFrame([("a", bytearray(good)), ("none", bytearray(b"no zip"))], "book string, content binary")
    assert [(r.page_no, r.name) for r in containers.archived_images(df, ["book"]).orderBy("page_no").collect()] == [(1, "b/p9.jpg"), (2, "b/p10.png")]
    bad = spark.createDataFrame([("a", bytearray(zip_of({"../p1.png": b"x"})))], "book string, content binary")
    with pytest.raises(Exception, match="leaves the archive"):
        containers.archived_images(bad, ["book"]).collect()


def test_pdb(spark):
    big = png(1, 1, 1500)
    rows = [("a", pdb([b"head", big, png(1, 1), jpeg(1, 1).ljust(1200, b"\0")])), ("short", b"\0" * 20), ("beyond", pdb([b"x"])[:78] + struct.pack(">II", 999, 0))]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "book string, content binary")
    assert [(r.page_no, r.record_no, r.ext) for r in containers.pdb_images(df, ["book"]).orderBy("page_no").collect()] == [(1, 1, "png"), (2, 3, "jpg")]
    assert {r.book for r in containers.pdb_records(df, ["book"]).where("error is not null").collect()} == {"short", "beyond"}


def test_package_round_trip(spark):
    images = spark.createDataFrame([("b", f"p{i}", "png", bytearray(png(*s))) for i, s in enumerate([(800, 1200), (800, 1200), (1600, 800), (800, 1200), (800, 1200), (100, 100)])], "book string, stem string, ext string, content binary")
    books = spark.createDataFrame([("b", "A & B", "x", "ja", "2024-01-01T00:00:00Z", True)], "book string, title string, author string, lang string, modified string, rtl boolean")
    assert [r.spread for r in packages.spine(packages.layout(images)).orderBy("pos").collect()] == ["center", "right", "center", "right", "left"]
    built = packages.build_fixed_layout(images, books)
    assert [(r.valid, r.errors) for r in packages.validate(built).collect()] == [(True, [])]
    broken = zip_of({"a.txt": b"", "META-INF/container.xml": packages.CONTAINER.encode(), "OEBPS/content.opf": b'<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="x" href="gone.png"/></manifest><spine><itemref idref="y"/></spine></package>'})
    df = spark.createDataFrame([("c", bytearray(broken)), ("d", bytearray(b"junk"))], "book string, content binary")
    got = {r.book: r.errors for r in packages.validate(df).collect()}
    assert got["c"] == ["mimetype is not the first, stored member", "missing: OEBPS/gone.png", "no cover image", "unknown idref: y"] and len(got["d"]) == 3
    merged = spark.createDataFrame([("m", "T", "# One\na\n# Two\nb\n")], "book string, title string, md string")
    assert not any("idref" in e or "missing" in e for e in packages.validate(packages.build_reflowable(merged)).first().errors)


def test_context(spark):
    answer = 'Here:\n```json\n{"title": "T", "author": "A", "year": 1990, "pages_per_image": "x", "content_type": "Verse", "table_of_contents": [{"title": "One"}], "proper_names": [{"seen": "a", "canonical": "b"}, {"seen": "c"}], "terminology": ["", "t"]}\n```'
    df = spark.createDataFrame([(answer,), ("[1]",), ('{"author": "x"}',), (None,)], "a string").select(context.parse(F.col("a")).alias("c"))
    got = [r.b for r in df.select(F.when(F.col("c").isNotNull(), context.render(F.col("c"))).alias("b")).collect()]
    assert got[1:] == [None, None, None]
    for line in ("Sách: T — A (1990)", context.PER_IMAGE + "1", context.VERSE_RULE, context.TOC + "One tr.None", context.NAMES + "a→b", context.TERMS + "t"):
        assert line in got[0].split("\n")


def test_outcomes(spark):
    e, m = "empty content (finish_reason=length)", "malformed response line 1"
    cases = {"twice": ([e, e], "dead", 2), "busy": (["HTTP 429"] * 6, "fail", 5), "between": ([e, "HTTP 503", e, None], "ok", 4), "classes": ([e, m, None], "ok", 3), "numbers": ([m, "malformed response line 77 | body[:9]=z"], "dead", 2), "refused": (["HTTP 400 data_inspection_failed"], "dead", 1), "plain": (["HTTP 403"], "fail", 1), "blank": ([attempts.BLANK_MARK], "blank", 1)}
    rows = [(p, i, msg, 10, 1) for p, (ms, _, _) in cases.items() for i, msg in enumerate(ms)]
    df = spark.createDataFrame(rows, "page string, n int, msg string, tokens_in long, tokens_out long")
    got = {r.page: (r.outcome, r.attempt, r.tokens_in) for r in attempts.outcomes(df, ["page"], ["n"]).collect()}
    assert got == {p: (o, a, 10 * a) for p, (_, o, a) in cases.items()}


def test_headings_and_slugs(spark):
    yes = ["Chương 1", "PHẦN II: Mở", "Hồi thứ nhất", "Phần mở đầu — Khai"]
    no = ["Phần lớn người", "Chương 1 của anh", "Phần thứ hai của", "Chương 1: " + "A" * 90, "x"]
    df = spark.createDataFrame([(s,) for s in yes + no], "s string")
    assert [r.h for r in df.select(text.is_heading(F.col("s")).alias("h")).collect()] == [True] * 4 + [False] * 5
    df = spark.createDataFrame([("Đêm Trắng",), ("ｅ１",), ("日本",), (None,)], "s string")
    assert [r.x for r in df.select(text.slugify("s").alias("x")).collect()] == ["dem-trang", "e1", "book", "book"]


def test_line_separators_and_costs(spark):
    df = spark.createDataFrame([("b", "p1", "a\r\nb c\n"), ("b", "p2", " \n"), ("b", "p3", None)], "book string, stem string, md string")
    assert [r.line for r in lines.explode_lines(df).orderBy("line_no").collect()] == ["a", "b", "c"]
    assert lines.merge_stats(df).first().pages_merged == 3
    rows = spark.createDataFrame([("nope", 1_000_000, 0), ("qwen/qwen3.7-flash", 0, 1_000_000)], "model string, tokens_in long, tokens_out long")
    assert sorted(str(r.cost_usd) for r in cost.priced(rows, cost.price_table(spark)).collect()) == ["0.130000", "0.320000"]


def test_recognition_resumes_and_breaks(spark, tmp_path):
    p = spark.createDataFrame([("b", f"p{i}", bytearray(c), "") for i, c in enumerate([b"one", b"", b"two"])], "book string, stem string, content binary, prompt string")
    done = str(tmp_path / "done")
    assert recognize.run_pass(spark, p, done) == 0
    assert recognize.run_pass(spark, p, done) == 0 and spark.read.parquet(done).count() == 3
    broke = spark.createDataFrame([("b", "q", bytearray(b"402"), "")] + [("b", f"r{i}", bytearray(b"x"), "") for i in range(3)], p.schema).coalesce(1)
    assert [r.msg[:8] for r in recognize.recognize(broke).collect()] == ["HTTP 402"] + ["skipped:"] * 3
    assert recognize.run_pass(spark, broke, str(tmp_path / "d2"), batches=2) >= 1


def test_stream_takes_new_files_only(spark, tmp_path):
    schema = "book string, stem string, content binary, prompt string"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i in range(2):
        spark.createDataFrame([("b", f"p{i}", bytearray(b"x"), "")], schema).write.mode("append").parquet(src)
        recognize.stream_new_pages(spark, src, out, ck, schema)
        assert spark.read.parquet(out).count() == i + 1


def test_sample_sizes(spark):
    for n, want in ((1, 1), (15, 15), (16, 14), (17, 14), (18, 15), (152, 15)):
        df = spark.range(n).withColumn("b", F.lit(1))
        got = sorted(r.id for r in pages.context_sample(df, "b", [F.col("id")]).collect())
        assert len(got) == want and (n != 152 or got[7] == 74)


def test_conversions_take_the_first_backend_that_works(spark):
    def broken(data, *_):
        raise ValueError("no such program")

    df = spark.createDataFrame([("a", "HEIC", bytearray(b"x")), ("b", "png", bytearray(b"y")), ("c", "heif", None)], "stem string, ext string, content binary")
    got = {r.stem: (r.ext, r.content and bytes(r.content), r.error) for r in convert.heic_to_jpg(df, [broken, lambda b: b + b"!"]).collect()}
    assert got == {"a": ("jpg", b"x!", None), "b": ("png", b"y", None), "c": ("jpg", None, "no content")}
    assert "no such program" in convert.heic_to_jpg(df.where("stem = 'a'"), [broken]).first().error
    pdfs = spark.createDataFrame([("a", bytearray(b"12")), ("b", None)], "book string, content binary")
    split = lambda data, dpi: [bytes([c]) for c in data]
    assert [(r.page_no, bytes(r.content)) for r in convert.pdf_pages(pdfs, ["book"], backends=[split]).orderBy("page_no").collect()] == [(1, b"1"), (2, b"2")]
    assert {r.error for r in convert.pdf_pages(pdfs, ["book"], backends=[broken]).collect()} == {"broken: no such program"}
    rar = convert.rar_images(pdfs.where("book = 'a'"), ["book"], lambda b: [("p10.png", b), ("p9.png", b), ("x.txt", b)])
    assert [r.name for r in rar.orderBy("page_no").collect()] == ["p9.png", "p10.png"]


def test_summary(spark):
    df = spark.createDataFrame([("r", 1, "start", '{"total": 5, "skipped": 2}'), ("r", 2, "page_ok", "{}"), ("r", 3, "done", '{"ok": 3, "cost_usd": 0.0123456}'), ("q", 1, "page_ok", None)], "run string, seq long, event string, payload string")
    got = {r.run: (r.ok, r.blank, r.fail, r.skipped, r.total, str(r.cost_usd)) for r in summaries.run_summary(df, ["run"]).collect()}
    assert got == {"r": (3, 0, 0, 2, 5, "0.012346"), "q": (0, 0, 0, 0, 0, "0.000000")}
    s = spark.range(1).select(summaries.summary_json(F.lit("ocr"), F.lit("ok"), F.struct(F.lit(1).alias("ok")), F.lit(0.12345), md=F.lit("a.md"), epub=F.lit(None).cast("string")).alias("s")).first().s
    assert s == '{"status":"ok","stage":"ocr","pages":{"ok":1},"cost_usd":0.1235,"paths":{"md":"a.md"}}'


def test_drive_links(spark):
    urls = {"https://drive.google.com/uc?id=a": (True, True), "https://drive.google.com/file/d/a?id=b": (True, False), "https://drive.google.com/open?x=1&id=a": (True, True), "https://drive.google.com/open?id=": (True, False), "ftp://drive.google.com/folders/a": (False, False), "http://x.org/?u=drive.google.com/folders/a": (False, False)}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: (r.d, r.f) for r in df.select("u", files.is_drive(F.col("u")).alias("d"), files.is_drive_folder(F.col("u")).alias("f")).collect()} == urls


def test_notes_of_whole_texts_are_those_of_the_lines(spark):
    r = random.Random(1)
    bits = ["```", "```md", "```markdown  ", "``` x", "a[^3] b", "[^12]", "", "x", "[^7]", "```\t", "````"]
    texts = ["".join(r.choice(bits) + r.choice(["\n", "\r\n", "\r", "\x0b", " "]) for _ in range(r.randint(0, 7))) for _ in range(1500)]
    texts += [None, "[^5] long\n" + "word\n" * 200_000 + "```\n[^6]", "```\n" + "word [^2]\n" * 200_000 + "```\ntail [^9]"]
    page = ["book", "stem"]
    df = spark.createDataFrame([("b", f"p{i}", t) for i, t in enumerate(texts)], "book string, stem string, md string")
    fenced = lines.with_fences(lines.strip_outer_fence(lines.explode_lines(df), page), page)
    number = F.when(~F.col("is_fence") & ~F.col("in_fence"), F.array_max(text.note_numbers(F.col("line"))))
    want = fenced.groupBy(*page).agg(F.coalesce(F.max(number), F.lit(0)).alias("max_note"))
    got = {r.stem: r.max_note for r in lines.page_notes(df, page).collect()}
    assert got == {r.stem: r.max_note for r in want.collect()}
    assert (got["p1501"], got["p1502"]) == (5, 2)


def test_passes_pay_for_no_page_twice(spark, tmp_path):
    """Dead and blank pages are done with; a shortage of credit stops its own pass only; failures stay open."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def recognizer(content, prompt):
        import uuid

        kind = bytes(content).decode()
        (calls / f"{kind}-{uuid.uuid4().hex}").touch()
        answer = {"md": None, "finish": None, "tokens_in": 1, "tokens_out": 0, "msg": None}
        if kind == "paid" and not (calls / "topped-up").exists():
            return answer | {"msg": "HTTP 402"}
        told = {"blank": {"finish": "stop"}, "dead": {"msg": "malformed response 7"}, "fail": {"msg": "HTTP 403"}}
        return answer | told.get(kind, {"md": kind, "finish": "stop"})

    kinds = ["ok", "blank", "dead", "fail", "paid"]
    pages_ = spark.createDataFrame([("b", k, bytearray(k.encode()), "") for k in kinds], "book string, stem string, content binary, prompt string")
    out = str(tmp_path / "done")
    n = lambda k: len(list(calls.glob(f"{k}-*")))
    left = recognize.run_pass(spark, pages_.where("stem <> 'paid'"), out, recognizer, pause=lambda s: None)
    assert left == 1 and (n("ok"), n("blank"), n("dead"), n("fail")) == (1, 1, 2, 1)
    assert recognize.run_pass(spark, pages_, out, recognizer, batches=1, pause=lambda s: None) == 2
    (calls / "topped-up").touch()
    assert recognize.run_pass(spark, pages_, out, recognizer, batches=3, pause=lambda s: None) == 1  # an old shortage does not stop it
    assert (n("ok"), n("blank"), n("dead")) == (1, 1, 2) and n("paid") == 2
    texts = {r.stem: r.md for r in recognize.page_texts(recognize.read_results(spark, out)).collect()}
    assert texts == {"ok": "ok", "paid": "paid", "blank": "<!-- blank page -->", "dead": "<!-- OCR FAILED (deterministic): malformed response # -->"}


def test_waits_between_attempts():
    waited = []
    answer = {"md": None, "finish": None, "tokens_in": 3, "tokens_out": 1, "msg": "HTTP 503"}
    got = recognize.attempted(b"x", "", lambda c, p: answer, 4, waited.append)
    assert waited == [1.0, 2.5, 5.0, 9.5] and (got["outcome"], got["attempts"], got["tokens_in"]) == ("fail", 5, 15)


def test_batches_stop_without_credit():
    script = {"a": [(True, False)], "b": [(False, False), (True, False)], "c": [(False, False)] * 2, "d": [(False, True)], "e": []}
    outcomes, left = batch.run_batch("abcde", lambda slug, n: script[slug][n - 1])
    assert outcomes == {"a": "output", "b": "output", "c": "given_up", "d": "unpaid"} and left == ["e"]


def test_queues_without_their_columns(spark, tmp_path):
    (tmp_path / "q.csv").write_text('slug,title\na,"x, ""y"""\n')
    with pytest.raises(ValueError, match="pdf_path"):
        batch.read_queue(spark, str(tmp_path / "q.csv"))
    (tmp_path / "r.csv").write_text('pdf_path,slug\n/a.pdf,a\n/b.pdf,b\n')
    assert [tuple(r) for r in batch.read_queue(spark, str(tmp_path / "r.csv"), limit=1).collect()] == [("a", None, None, "/a.pdf")]


def test_logs_are_read_whole(spark, tmp_path):
    for name, body in (("a-b.2.log", "x\n2 trang DEAD placeholder\n"), ("a-b.10.log", "HTTP 429\n"), ("c.1.log", ""), ("notes.txt", "no")):
        (tmp_path / name).write_text(body)
    logs = batch.read_logs(spark, str(tmp_path))
    assert sorted((r.slug, r.log_no, r.text.count("\n")) for r in logs.collect() if r.text) == [("a-b", 2, 2), ("a-b", 10, 1)]
    assert {r.slug: r.dead for r in attempts.last_dead(logs, ["slug"]).collect()}["a-b"] == 2


def test_markdown_documents():
    md = "Before\n\n# One *two*\nText **bold** `a<b` [x](http://y) note[^1]  \nnext\n## Sub\n> said\n\n- a\n- b\n\n1. c\n\n* * *\n```\n# no heading\n```\n[^1]: told\n# Last\n" + "> " * 3000 + "deep"
    first, one, last = markdown.sections(md)
    assert (first.title, one.title, last.title, one.subtitles) == ("", "One *two*", "Last", ["Sub"])
    html = markdown.body(one.lines)
    for part in ("<h1>One <em>two</em></h1>", "<strong>bold</strong>", "<code>a&lt;b</code>", '<a href="http://y">x</a>', 'href="#note-1"', "<br/>", '<h2 id="part-1">Sub</h2>', "<blockquote><p>said</p></blockquote>", "<ul><li>a</li><li>b</li></ul>", "<ol><li>c</li></ol>", "<hr/>", "<pre><code># no heading</code></pre>", 'id="note-1"'):
        assert part in html
    assert "deep" in markdown.body(last.lines)
    ElementTree.fromstring(f'<body xmlns:epub="e">{html}</body>')


def test_reflowable_package_is_whole(spark):
    row = [("b", "# A & B\ntext\n## C\n\n# D\nmore", "T < U", "me", bytearray(png(8, 8)), "png")]
    built = packages.build_reflowable(spark.createDataFrame(row, "book string, md string, title string, author string, cover binary, ext string"))
    assert [(r.valid, r.errors) for r in packages.validate(built).collect()] == [(True, [])]
    members = {r.name: bytes(r.content).decode(errors="replace") for r in containers.zip_members(built, ["book"]).collect()}
    assert "<li><a href=\"text/0001.xhtml#part-1\">C</a></li>" in members["OEBPS/nav.xhtml"] and "<dc:creator>me</dc:creator>" in members["OEBPS/content.opf"]
    assert {"OEBPS/cover.png", "OEBPS/text/0002.xhtml"} <= set(members)


def test_pending_pages_of_buckets_are_not_shuffled(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("b"), F.col("id") % 3).alias("book"), F.col("id").cast("string").alias("stem"))
    done = rows.where("stem % 4 = 0").withColumn("size", F.lit(5))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = pages.bucketed(rows, "own_pages", ["book", "stem"], 4, str(tmp_path / "pages"))
        two = pages.bucketed(done.limit(10), "own_results", ["book", "stem"], 4, str(tmp_path / "results"))
        two = pages.bucketed(done, "own_results", ["book", "stem"], 4, str(tmp_path / "results"), "append")
        left = pages.pending(one, two, ["book", "stem"])
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert left.count() == 150 and two.count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS own_pages")
        spark.sql("DROP TABLE IF EXISTS own_results")
