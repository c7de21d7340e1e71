"""Registered queries of books, batches, contexts and packages, each with its SQL for DuckDB."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import files, text
from quire.operators import attempts, batch, context, cost, lines, packages, pages
from quire.plans.queries import ANSWER, MARKED, ORACLE_SQL, PAGES_SQL, attempt_rows, packaged_parts, query, table
from quire.sources import containers, inputs
from quire.sources.scratch import scratch_dir
from quire.streaming import attempt_state, lanes, recognize, requests, smoke


@query(r"""SELECT 'c' || s_suppkey AS slug, s_name || ', "the" one' || CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || 'second line' ELSE '' END AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'A; B' END AS authors, '/in/' || s_suppkey || '.pdf' AS pdf_path FROM supplier""")
def queue_books(spark, sf_dir):
    """A queue written as CSV with quotes, commas and line ends in its fields, and read back."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    title = F.concat("s_name", F.lit(', "the" one'), F.when(n % 3 == 0, F.lit("\nsecond line")).otherwise(""))
    path = scratch_dir(spark, "queue")
    s.select(F.concat(F.lit("/in/"), n, F.lit(".pdf")).alias("pdf_path"), F.concat(F.lit("c"), n).alias("slug"), F.when(n % 2 == 0, "A; B").alias("authors"), title.alias("title")).write.option("header", True).option("escape", '"').csv(path)
    return batch.read_queue(spark, path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ['b' || c_custkey] ELSE ['a' || c_custkey, c_mktsegment] END AS slugs FROM customer")
def slug_lists(spark, sf_dir):
    n = F.col("c_custkey").cast("string")
    given = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" b"), n, F.lit(" ,,"))).otherwise(F.concat(F.lit("a"), n, F.lit(", "), "c_mktsegment", F.lit(" , ")))
    return table(spark, sf_dir, "customer").select("c_custkey", batch.listed_slugs(given).alias("slugs"))


@query("""SELECT 'K' || p_brand AS key, arg_min(CASE p_partkey % 3 WHEN 0 THEN p_name || '=' || p_size WHEN 1 THEN p_name ELSE '' END, p_partkey) AS value FROM part
WHERE p_partkey % 5 > 1 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_partkey % 7 = 0) GROUP BY p_brand""")
def env_settings(spark, sf_dir):
    """Lines of settings made from parts: comments, lines without a value, quoted values; brands that are set already."""
    k, name = F.col("p_partkey"), F.concat(F.lit(" K"), "p_brand", F.lit(" = "))
    value = F.when(k % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit("="), "p_size", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("'"), "p_name", F.lit("'"))).otherwise("")
    line = F.when(k % 5 == 0, F.concat(F.lit("# "), name, value)).when(k % 5 == 1, F.lit("no setting")).otherwise(F.concat(name, value))
    p = table(spark, sf_dir, "part")
    known = p.where("p_size = 1 AND p_partkey % 7 = 0").select(F.concat(F.lit("K"), "p_brand").alias("key")).distinct()
    return batch.added_settings(batch.settings(p.select(k.alias("order"), line.alias("line"))), known)


#: Runs of books: each order of a customer is a pass.
RUNS_SQL = "runs AS (SELECT o_custkey AS slug, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pass_no, o_orderkey % 3 = 0 AS has_output, o_orderkey % 7 = 0 AS unpaid, CAST(o_orderkey % 100 AS BIGINT) AS secs FROM orders)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS slug", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pass_no", "o_orderkey % 3 = 0 AS has_output", "o_orderkey % 7 = 0 AS unpaid", "o_orderkey % 100 AS secs")


@query(f"""WITH {RUNS_SQL}, e AS (SELECT *, CASE WHEN has_output THEN 'output' WHEN unpaid THEN 'unpaid' WHEN pass_no = 2 THEN 'given_up' END AS ending FROM runs WHERE pass_no <= 2),
f AS (SELECT slug, min(pass_no) FILTER (WHERE ending IS NOT NULL) AS ended FROM e GROUP BY slug)
SELECT e.slug, CAST(count(*) AS INTEGER) AS passes, coalesce(max(ending) FILTER (WHERE pass_no = ended), 'open') AS outcome, CAST(sum(secs) AS BIGINT) AS secs FROM e JOIN f USING (slug) WHERE ended IS NULL OR pass_no <= ended GROUP BY e.slug""")
def batch_passes(spark, sf_dir):
    return batch.batch_outcomes(runs(spark, sf_dir))


@query("""WITH r AS (SELECT c_custkey AS slug, c_nationkey AS lane, CASE WHEN c_custkey % 5 = 0 THEN 'WARN(no-epub)' WHEN c_custkey % 3 = 0 THEN 'DONE(dead=2)' ELSE 'DONE' END AS label, CAST(c_custkey % 60 AS BIGINT) AS secs, CAST(c_custkey % 4 AS BIGINT) AS n429 FROM customer WHERE c_custkey % 9 > 0),
l AS (SELECT lane, count(*) AS books, count(*) FILTER (WHERE starts_with(label, 'DONE')) AS done, sum(secs) AS secs, sum(n429) AS n429 FROM r GROUP BY lane)
SELECT CAST(sum(books) AS BIGINT) AS books, CAST(sum(done) AS BIGINT) AS done, CAST(sum(secs) AS BIGINT) AS total_secs, CAST(max(secs) AS BIGINT) AS wall_secs, CAST(sum(secs) AS DOUBLE) / CAST(max(secs) AS DOUBLE) AS speedup, CAST(sum(n429) AS BIGINT) AS n429,
  (SELECT list(c_custkey ORDER BY c_custkey) FROM customer WHERE c_custkey % 9 = 0) AS not_started FROM l""")
def batch_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("slug", F.col("c_custkey"))
    k = F.col("slug")
    label = F.when(k % 5 == 0, "WARN(no-epub)").when(k % 3 == 0, "DONE(dead=2)").otherwise("DONE")
    results = c.where(k % 9 > 0).select("slug", F.col("c_nationkey").alias("lane"), label.alias("label"), (k % 60).alias("secs"), (k % 4).alias("n429"))
    return batch.rollup(results, c.select("slug"))


@query("SELECT source AS slug, count(*) AS texts FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source")
def queued_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    queue = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("slug")).distinct()
    found = batch.with_text(queue, d.select(F.col("doc_id").alias("slug"), F.col("text").alias("md")))
    return found.join(d.select(F.col("doc_id").alias("slug"), "source"), "slug").groupBy(F.col("source").alias("slug")).agg(F.count("*").alias("texts"))


@query("SELECT DISTINCT 'h' || l_suppkey AS home FROM lineitem WHERE l_linenumber IN (2, 5)")
def book_homes(spark, sf_dir):
    child = F.when(F.col("l_linenumber") == 2, "scans").when(F.col("l_linenumber") == 5, "dist").otherwise(F.concat(F.lit("x"), "l_linenumber"))
    return pages.book_homes(table(spark, sf_dir, "lineitem").select(F.concat(F.lit("h"), "l_suppkey").alias("home"), child.alias("child")))


@query("SELECT doc_id, doc_id % 3 > 0 AS is_path, CASE doc_id % 3 WHEN 0 THEN 'slug' || doc_id WHEN 1 THEN '/a/' || doc_id ELSE lang || '/c' END AS clean FROM documents")
def path_names(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("slug"), n)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/a/./b//../"), n)).otherwise(F.concat(F.lit("..\\"), "lang", F.lit("\\x\\..\\c")))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return d.select("doc_id", pages.is_path(F.col("name")).alias("is_path"), pages.normalized(F.col("name")).alias("clean"))


@query("SELECT p_partkey AS book, 'scans/' || p_size || '.jpg' AS path FROM part WHERE p_partkey % 4 IN (0, 1) AND p_partkey % 3 > 0")
def covers_within(spark, sf_dir):
    """Covers named plainly, by a detour, outside of the scans, or absolutely; every third book's file is not there."""
    k, name = F.col("p_partkey") % 4, F.concat(F.col("p_size").cast("string"), F.lit(".jpg"))
    cover = F.when(k == 0, name).when(k == 1, F.concat(F.lit("x/../"), name)).when(k == 2, F.concat(F.lit("../"), name)).otherwise(F.concat(F.lit("/scans/"), name))
    p = table(spark, sf_dir, "part")
    there = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("book"), F.concat(F.lit("scans/"), name).alias("path"))
    return pages.covers_within(p.select(F.col("p_partkey").alias("book"), cover.alias("cover")), there).select("book", "path")


@query("SELECT c_custkey AS book, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 4 = 0) AS blocked FROM customer c")
def reimport_guard(spark, sf_dir):
    stem = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("page_"), "o_orderkey")).otherwise(F.concat(F.lit("cover_"), "o_orderkey"))
    there = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), stem.alias("stem"))
    return pages.importable_books(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book")), there)


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'lies' WHEN lang = 'fr' THEN 'lis' ELSE 'read' END AS prompt FROM documents")
def prompt_lookup(spark, sf_dir):
    prompts = spark.createDataFrame([("vi", "read"), ("de", "lies"), ("fr", "lis")], "lang string, prompt string")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("lang"))).otherwise(F.col("lang")).alias("lang"))
    return pages.with_prompt(d, prompts).select("doc_id", "prompt")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'given' WHEN c_custkey IS NOT NULL AND c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS block FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def attached_contexts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("book", F.col("c_custkey"))
    explicit = c.where("book % 6 = 0").select("book", F.lit("given").alias("block"))
    cached = c.select("book", F.when(F.col("book") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("block"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("book"))
    return pages.attach_context(o, explicit, cached).select("o_orderkey", "block")


def contexts(spark, sf_dir):
    # Answers take more time than bytes: dealt out to all cores, by the key that their joins use.
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "book").repartition(spark.sparkContext.defaultParallelism, "book")
    return c.select("book", F.explode(F.array(context.parse(F.expr(ANSWER.replace("c_custkey", "book"))))).alias("context")).where("context is not null")


@query("SELECT c_custkey AS book, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS author, 'stub' AS made_by, true AS same_block FROM customer WHERE c_custkey % 11 <> 0")
def saved_contexts(spark, sf_dir):
    """Contexts kept as JSON and read back: the fields, what made them, and the block that they render to."""
    kept = context.saved(contexts(spark, sf_dir), "stub")
    back = context.loaded(kept.select("book", F.concat(F.lit("```json\n"), "json", F.lit("\n```")).alias("json")))
    both = back.join(kept, "book")
    return both.select("book", "context.title", "context.author", F.get_json_object("json", "$._generated_by").alias("made_by"), (context.render(F.col("context")) == F.col("block")).alias("same_block"))


@query("SELECT c_custkey AS book, CAST(c_custkey % 4 AS INTEGER) AS toc, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS INTEGER) AS names FROM customer")
def context_counts(spark, sf_dir):
    k = F.col("c_custkey")
    entry = F.concat(F.lit('{"title": "x", "page": '), k, F.lit("}"))
    names = F.when(k % 5 == 0, F.lit("null")).otherwise('[{"seen": "a", "canonical": "b"}, {"seen": "c", "canonical": "d"}]')
    answer = F.concat(F.lit('{"title": "t", "table_of_contents": ['), F.array_join(F.array_repeat(entry, (k % 4).cast("int")), ", "), F.lit('], "proper_names": '), names, F.lit("}"))
    c = table(spark, sf_dir, "customer").select(k.alias("book"), context.counts(context.parse(answer)).alias("n"))
    return c.select("book", "n.*")


@query("SELECT p_brand AS book, CAST(greatest(count(*) FILTER (WHERE n = 1 OR p_size % 9 = 0) - 1, 0) AS BIGINT) AS doubles FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) GROUP BY p_brand")
def double_pages(spark, sf_dir):
    numbered = table(spark, sf_dir, "part").selectExpr("p_brand AS book", "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page_no", "CASE WHEN p_size % 9 = 0 THEN 1600 ELSE 800 END AS w", "1200 AS h")
    return packages.double_pages(packages.spine(numbered))


@query("SELECT p_partkey, p_partkey % 4 > 0 AS known FROM part")
def payload_kinds(spark, sf_dir):
    k = F.col("p_partkey") % 4
    content = F.when(k == 0, F.concat(F.lit("<html>"), "p_name")).when(k == 1, F.concat(F.lit("%PDF-1.4 "), "p_name"))
    raw = F.coalesce(F.encode(content, "UTF-8"), F.when(k == 2, F.unhex(F.lit("504B030400"))).otherwise(F.unhex(F.lit("526172211A0700"))))
    return table(spark, sf_dir, "part").select("p_partkey", files.is_payload(raw).alias("known"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'blank' WHEN 1 THEN 'transient' WHEN 2 THEN 'transient' END AS outcome FROM events")
def blank_answers(spark, sf_dir):
    k = F.col("event_id") % 4
    content = F.when(k == 0, " \n\t").when(k == 1, "").when(k == 3, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", attempts.empty_outcome(content, F.when(k == 0, "stop").when(k == 1, "length")).alias("outcome"))


@query("SELECT p_brand AS book, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) WHERE n <= 5")
def cover_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book"), "p_partkey")
    return pages.cover_candidates(p, page_no="p_partkey").select("book", "p_partkey")


@query("""WITH t AS (SELECT c_custkey AS target, c_custkey % 3 AS k FROM customer)
SELECT target, label, CASE WHEN k = 0 AND target % 2 = 0 OR k = 1 AND target % 5 = 0 THEN 'MISSING' WHEN target % 4 = 0 THEN 'TINY' WHEN target % 7 = 0 THEN 'BADZIP' ELSE 'OK' END AS status
FROM (SELECT CASE k WHEN 0 THEN 'f' || target || '.epub' WHEN 1 THEN 'lib/b' || target ELSE 'shelf' || target END AS t, target, k, CASE k WHEN 0 THEN 'f' || target || '.epub' WHEN 1 THEN 'lib/b' || target ELSE 'shelf' || target || '/h' || unnest([1, 2]) END AS label FROM t WHERE k = 2
  UNION ALL SELECT '', target, k, CASE k WHEN 0 THEN 'f' || target || '.epub' ELSE 'lib/b' || target END FROM t WHERE k < 2)""")
def verify_targets(spark, sf_dir):
    """Targets that are files (every second is not there), homes (every fifth has no package) and folders of two homes."""
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    t = table(spark, sf_dir, "customer").select("c_custkey", k.alias("k"), F.when(k == 0, F.concat(F.lit("f"), n, F.lit(".epub"))).when(k == 1, F.concat(F.lit("lib/b"), n)).otherwise(F.concat(F.lit("shelf"), n)).alias("target"))
    homes = t.where("k > 0").select("c_custkey", "k", F.explode(F.when(F.col("k") == 1, F.array("target")).otherwise(F.array(F.concat("target", F.lit("/h1")), F.concat("target", F.lit("/h2"))))).alias("home"))
    size, ok = F.when(F.col("c_custkey") % 4 == 0, 10).otherwise(20_000).cast("long").alias("size"), (F.col("c_custkey") % 7 > 0).alias("zip_ok")
    single = t.where("k = 0 AND c_custkey % 2 > 0").select(F.col("target").alias("path"), size, ok)
    packed = homes.where("k = 2 OR c_custkey % 5 > 0").select(F.concat("home", F.lit("/dist/x.epub")).alias("path"), size, ok)
    found = packages.verify_targets(t.select("target"), single.union(packed), homes.select("home"))
    told = found.join(t.withColumnRenamed("c_custkey", "key"), "target")
    return told.select(F.col("key").alias("target"), "label", packages.archive_status(F.col("exists"), F.col("size"), F.col("zip_ok")).alias("status"))


DEFECTS = ("none", "mimetype", "damaged", "href", "idref", "cover", "container", "malformed", "no_opf", "no_zip", "no_spine")


def damaged(content: bytes, defect: str) -> bytes:
    """A valid package with one defect put in."""
    if defect == "no_zip":
        return content[:40]
    z = zipfile.ZipFile(io.BytesIO(content))
    members = [(i.filename, z.read(i)) for i in z.infolist()]
    opf = "OEBPS/content.opf"
    change = {
        "href": (b'href="nav.xhtml"', b'href="gone.xhtml"'), "idref": (b'idref="leaf-00001"', b'idref="leaf-x"'), "cover": (b' properties="cover-image"', b""), "malformed": (b"</package>", b"</pack"), "no_spine": (b"spine", b"spun"),
    }.get(defect)
    if defect == "mimetype":
        members = members[1:] + members[:1]
    if defect in ("container", "no_opf"):
        members = [m for m in members if m[0] != (packages.CONTAINER_PATH if defect == "container" else opf)]
    if change:
        members = [(n, c.replace(*change) if n == opf else c) for n, c in members]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for k, (n, c) in enumerate(members):
            new.writestr(zipfile.ZipInfo(n), c, zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED)
    raw = bytearray(out.getvalue())
    if defect == "damaged":  # a byte of the first member, which is stored
        raw[raw.find(packages.MIMETYPE.encode())] ^= 1
    return bytes(raw)


@query("""WITH b AS (SELECT DISTINCT p_brand AS book, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 11 AS d FROM part)
SELECT book, d = 0 AS valid, CASE d WHEN 0 THEN [] WHEN 1 THEN ['mimetype is not the first, stored member'] WHEN 2 THEN ['a member is damaged', 'mimetype is not the first, stored member'] WHEN 3 THEN ['missing: OEBPS/gone.xhtml']
  WHEN 4 THEN ['unknown idref: leaf-x'] WHEN 5 THEN ['no cover image'] WHEN 6 THEN ['no package document named'] WHEN 7 THEN ['the package document is not well-formed'] WHEN 8 THEN ['the package document is missing']
  WHEN 9 THEN ['a member is damaged', 'mimetype is not the first, stored member', 'no package document named'] ELSE ['no spine'] END AS errors FROM b""")
def broken_packages(spark, sf_dir):
    """A package for each brand, ten in eleven with a defect of their own; the brand's number tells which."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            number = [int("".join(c for c in b if c.isdigit())) for b in part.book]
            yield part.assign(content=[damaged(c, DEFECTS[n % len(DEFECTS)]) for c, n in zip(part.content, number)])

    broken = packaged_parts(spark, sf_dir).mapInPandas(run, "book string, content binary")
    return packages.validate(broken).select("book", "valid", "errors")


def scripted(content: bytes, prompt: str) -> dict:
    """A recogniser that answers by the page's number: text, blank, the same or changing damage, a busy service that
    recovers or does not, refusal, an error for good."""
    n = int(content)
    SEEN[n] += 1
    answer = {"md": None, "finish": None, "tokens_in": 10, "tokens_out": n % 5, "msg": None}
    kind, again = n % 9, SEEN[n]
    if kind == 0 or (kind == 5 and again > 2):
        return answer | {"md": f"text {n}", "finish": "stop"}
    if kind == 1:
        return answer | {"md": " ", "finish": "stop"}
    messages = {2: f"malformed response at {again} | body[:9]=x", 3: "empty content" if again % 2 else "malformed response", 4: "HTTP 429", 5: "HTTP 503", 6: "HTTP 400 data_inspection_failed", 7: "HTTP 403"}
    return answer | ({"md": "", "finish": "length"} if kind == 8 else {"msg": messages[kind]})


SEEN: Counter = Counter()


@query("""SELECT doc_id, ['ok', 'blank', 'dead', 'fail', 'fail', 'ok', 'dead', 'fail', 'dead'][doc_id % 9 + 1] AS outcome, CAST(a AS INTEGER) AS attempts, CAST(10 * a AS BIGINT) AS tokens_in, CAST(doc_id % 5 * a AS BIGINT) AS tokens_out, doc_id % 9 IN (3, 4, 7) AS open
FROM (SELECT doc_id, [1, 1, 2, 5, 5, 3, 1, 1, 2][doc_id % 9 + 1] AS a FROM documents)""")
def recognition_outcomes(spark, sf_dir):
    """Pages whose recogniser fails in all ways that are told apart; attempts, what they cost, and what stays open."""
    d = table(spark, sf_dir, "documents").select(F.lit("b").alias("book"), F.col("doc_id").cast("string").alias("stem"), F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("content"), F.lit("").alias("prompt"))

    def fresh(content: bytes, prompt: str) -> dict:
        answer = scripted(content, prompt)
        if answer["md"] and answer["md"].strip():
            SEEN[int(content)] = 0
        return answer

    results = recognize.recognize(d, fresh, pause=lambda seconds: None)
    return results.select(F.col("stem").cast("long").alias("doc_id"), "outcome", "attempts", "tokens_in", "tokens_out", (~F.col("outcome").isin(*recognize.TERMINAL)).alias("open"))


@query("SELECT 'b' AS book, CAST(doc_id AS STRING) AS stem, CASE WHEN doc_id % 4 = 0 THEN '<!-- blank page -->' ELSE text END AS md FROM documents WHERE doc_id % 4 < 3")
def recognized_texts(spark, sf_dir):
    """The page texts of results that came twice: placeholders of blank pages are texts, failures are not."""
    k = F.col("doc_id") % 4
    r = table(spark, sf_dir, "documents").select(F.lit("b").alias("book"), F.col("doc_id").cast("string").alias("stem"), F.when(k == 0, "blank").when(k == 3, "fail").otherwise("ok").alias("outcome"), F.when(k == 0, attempts.BLANK_TEXT).when(k < 3, F.col("text")).alias("md"))
    return recognize.page_texts(r.union(r))


@query(f"""WITH {PAGES_SQL}, u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Mục lục' ELSE 'Mu' || chr(803) || 'c lu' || chr(803) || 'c' END AS head FROM pages_)
SELECT doc_id, CAST(2 AS BIGINT) AS toc, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS demoted FROM u""")
def composed_headings(spark, sf_dir):
    """Contents headings and titles written with combining marks count like composed ones."""
    k = F.col("doc_id")
    toc = F.when(k % 2 == 0, "Mục lục").otherwise("Mục lục")
    own = F.when(k % 3 == 0, "## Tînh\n").otherwise("## Other\nbody\n")
    d = table(spark, sf_dir, "documents").select(k.cast("string").alias("text_id"), F.lit("tînh").alias("title"), F.lit(None).cast("array<string>").alias("authors"), F.concat(F.lit("## "), toc, F.lit("\nentry\n"), own, F.lit("## End\nx")).alias("md"))
    n = lambda a: F.count_if(F.col("action") == a)
    return lines.clean_contents(lines.explode_lines(d), book="text_id").groupBy(F.col("text_id").cast("long").alias("doc_id")).agg(n("toc").alias("toc"), n("demote").alias("demoted"))


@query("""WITH b AS (SELECT p_brand AS folder, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 4 AS k, count(*) AS n, count(*) FILTER (WHERE p_partkey % 97 <> 5) AS big FROM part GROUP BY 1, 2)
SELECT folder, CASE k WHEN 0 THEN 'images' WHEN 1 THEN 'zip' WHEN 2 THEN 'mixed' ELSE 'zip' END AS route, CAST(CASE k WHEN 0 THEN n WHEN 1 THEN big ELSE 0 END AS BIGINT) AS pages, CASE k WHEN 2 THEN 'mixed: png×' || n || ', zip×1' WHEN 3 THEN 'no pages' END AS error FROM b""")
def routed_pages(spark, sf_dir):
    """A folder for each brand: of images, of one package, of both (an error), or of an archive without any image."""
    number = F.regexp_extract("folder", "([0-9]+)", 1).cast("int") % 4
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex("p_size"), 8, "0"), F.lpad(F.hex("p_size"), 8, "0"))
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")).alias("name"), F.unhex(head).alias("content"))
    packed = "CAST(regexp_extract(book, '([0-9]+)', 1) AS INT) % 4 IN (1, 2)"  # the others' packages would be made for nothing
    zips = packaged_parts(spark, sf_dir, packed).select(F.col("book").alias("folder"), F.lit("x.zip").alias("name"), "content")
    empty = packages.build_reflowable(p.select(F.col("folder").alias("book")).distinct().withColumn("md", F.lit("text"))).select(F.col("book").alias("folder"), F.lit("y.zip").alias("name"), "content")
    given = p.where(number.isin(0, 2)).union(zips.where(number.isin(1, 2))).union(empty.where(number == 3))
    path = scratch_dir(spark, "inputs")
    given.write.parquet(path)  # each reader reads the stored files, not what made them
    return inputs.read_inputs(spark.read.schema(given.schema).parquet(path)).groupBy("folder", "route").agg(F.count("page_no").alias("pages"), F.max("error").alias("error"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 1")
def containers_without_pages(spark, sf_dir):
    """Containers of two records, every other of which holds an image that is too small to be a page."""
    u32 = lambda c: F.concat(F.lpad(F.hex(c), 8, "0"), F.lit("0" * 8))
    image = F.concat(F.lit("89504E470D0A1A0A"), F.when(F.col("p_partkey") % 2 == 0, F.repeat(F.lit("00"), 1200)).otherwise(F.repeat(F.lit("00"), 10)))
    whole = F.concat(F.lit("00" * 76), F.lit("0002"), u32(F.lit(94)), u32(F.octet_length("p_name") + 94), F.hex("p_name"), image)
    c = table(spark, sf_dir, "part").select("p_partkey", F.unhex(whole).alias("content"))
    return containers.without_pages(c, containers.pdb_images(c, ["p_partkey"]), ["p_partkey"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 's' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS author,
  CASE WHEN c_custkey % 3 > 0 AND c_custkey % 4 = 0 THEN 'de' ELSE 'vi' END AS lang, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '1990' END AS year FROM customer""")
def metadata_defaults(spark, sf_dir):
    k = F.col("c_custkey")
    whole = F.to_json(F.struct(F.when(k % 5 == 0, "").otherwise(F.col("c_name")).alias("title"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("author"), F.when(k % 4 == 0, "de").alias("lang"), F.lit(1990).alias("year")))
    document = F.when(k % 3 > 0, whole).when(k % 2 == 0, F.lit("{damaged"))
    c = table(spark, sf_dir, "customer").select("c_custkey", context.metadata(document, F.concat(F.lit("s"), k)).alias("m"))
    return c.select("c_custkey", "m.*")


@query("SELECT CAST(o_custkey AS STRING) AS book, 2 * count(*) AS entries, CAST(2 * sum(o_orderkey % 50) AS BIGINT) AS total FROM orders WHERE o_orderkey % 50 > 0 AND o_orderkey % 7 > 0 GROUP BY o_custkey")
def appended_ledger(spark, sf_dir):
    """A ledger that the same entries were appended to twice; those without a readable cost are kept aside."""
    usd = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise((F.col("o_orderkey") % 50).cast("string"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("book"), usd.alias("cost_usd"))
    path = scratch_dir(spark, "ledger")
    cost.append_ledger(entries, path)
    cost.append_ledger(entries, path)
    kept = cost.ledger_totals(spark.read.schema("book string, cost_usd decimal(18,6)").parquet(f"{path}/entries"), ["book"])
    return kept.select("book", "entries", F.col("total_usd").cast("long").alias("total"))


@query("SELECT source AS book, count(*) AS pages, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS tokens_in FROM documents GROUP BY source")
def streamed_pages(spark, sf_dir):
    """Pages recognised as a stream that is started twice: what the first run has done the second one leaves."""
    pages_ = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit("").alias("prompt"))
    path = scratch_dir(spark, "stream")
    for half in (0, 1):
        pages_.where(F.pmod(F.xxhash64("stem"), F.lit(2)) == half).write.mode("append").parquet(f"{path}/pages")
        recognize.stream_new_pages(spark, f"{path}/pages", f"{path}/done", f"{path}/checkpoint", "book string, stem string, content binary, prompt string", recognize.by_content)
    done = spark.read.schema(f"book string, stem string, {recognize.RESULT}").parquet(f"{path}/done")
    return done.groupBy("book").agg(F.count("*").alias("pages"), F.sum("tokens_in").alias("tokens_in"))


@query(ORACLE_SQL["early_abort"])
def streamed_attempts(spark, sf_dir):
    """The outcomes of early_abort from a stream of the attempts that ends in the middle of many pages and is started
    again: what it knew of them is state."""
    rows, path = attempt_rows(spark, sf_dir), scratch_dir(spark, "attempts")
    first = F.col("ts") < F.lit("2024-01-02").cast("timestamp")
    for part in (first, ~first):
        rows.where(part).write.mode("append").parquet(f"{path}/attempts")
        told = attempt_state.watched(spark.readStream.schema(rows.schema).parquet(f"{path}/attempts"), ["user_id"], F.col("event_id"))
        attempt_state.watch(spark, told, f"{path}/told", f"{path}/checkpoint").awaitTermination()
    told = spark.read.schema(f"user_id long, {attempt_state.TOLD}").parquet(f"{path}/told")
    return attempt_state.latest(told, ["user_id"])


@query("""SELECT p_partkey, ['png', 'gif', 'jpg'][p_partkey % 3 + 1] AS kind, CAST(p_size + 100 AS INTEGER) AS w, CAST(p_size * 7 + 300 AS INTEGER) AS h FROM part""")
def image_sizes(spark, sf_dir):
    """PNG, GIF and JPEG headers made from part sizes; the JPEG's frame lies behind another segment."""
    w, h, k = F.col("p_size") + 100, F.col("p_size") * 7 + 300, F.col("p_partkey") % 3
    big = lambda c, n: F.lpad(F.hex(c), n, "0")
    little = lambda c: F.concat(F.substring(big(c, 4), 3, 2), F.substring(big(c, 4), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 8), big(h, 8))
    gif = F.concat(F.lit("474946383961"), little(w), little(h), F.lit("0000"))
    jpg = F.concat(F.lit("FFD8FFE00004ABCDFFC2001108"), big(h, 4), big(w, 4), F.lit("00" * 12))
    p = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.when(k == 0, png).when(k == 1, gif).otherwise(jpg)).alias("content"))
    return p.select("p_partkey", files.sniff(F.col("content")).alias("kind"), files.image_size(F.col("content")).alias("size")).select("p_partkey", "kind", "size.w", "size.h")


def bytes_pages(spark, sf_dir):
    """Documents as pages of the books that their sources are."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem"), content.alias("content"), F.lit("").alias("prompt"))


BYTES_SQL = "b AS (SELECT doc_id, source AS book, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)"


@query("""WITH b AS (SELECT c_nationkey AS slug, c_custkey, CAST(octet_length(encode(c_name)) AS BIGINT) AS n FROM customer)
SELECT 'n' || slug AS slug, CASE slug WHEN 3 THEN 'failed' WHEN 7 THEN 'given_up' ELSE 'output' END AS outcome, CAST(CASE slug WHEN 3 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS INTEGER) AS passes,
  CAST(CASE slug WHEN 3 THEN 0 WHEN 7 THEN count(*) FILTER (WHERE c_custkey % 2 = 0) ELSE count(*) END AS BIGINT) AS pages, CAST(CASE slug WHEN 3 THEN 0 WHEN 7 THEN coalesce(sum(n) FILTER (WHERE c_custkey % 2 = 0), 0) ELSE sum(n) END AS BIGINT) AS tokens_in FROM b GROUP BY slug""")
def lane_books(spark, sf_dir):
    """Customers as pages of the books that their nations are, recognised in lanes: the pages of one book never all come
    to an end, and another one's break its jobs."""
    k, path = F.col("c_custkey"), scratch_dir(spark, "lanes")
    hurt = F.when(F.col("c_nationkey") == 3, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode("c_name", "UTF-8"))
    prompt = F.when((F.col("c_nationkey") == 7) & (k % 2 > 0), "fails").otherwise("")
    pages_ = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("book"), k.cast("string").alias("stem"), hurt.alias("content"), prompt.alias("prompt"))

    def answer(image: bytes, prompt: str) -> dict:
        return {"md": None, "finish": None, "tokens_in": 0, "tokens_out": 0, "msg": "HTTP 403"} if prompt else recognize.by_content(image, prompt)

    queue = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("slug"))
    told = lanes.run_lanes(spark, queue, lanes.recognizing(spark, pages_, path, answer, batches=1), lanes=6)
    done = recognize.terminal(recognize.read_results(spark, path)).groupBy(F.col("book").alias("slug")).agg(F.count("*").alias("pages"), F.sum("tokens_in").alias("tokens_in"))
    return told.join(done, "slug", "left").select("slug", "outcome", "passes", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"))


def asked_about(images: list[bytes], prompt: str) -> dict:
    """A model without a network: its answer is a function of the images, and of some no answer."""
    size = sum(map(len, images))
    answer = f'{{"title": "{len(images)} pages", "author": "{size}", "cover_page": {len(images) - size % 3}, "reason": "by size"}}'
    return {"md": answer if size % 5 else "nothing to say", "tokens_in": size, "tokens_out": len(answer), "msg": "HTTP 500" if size % 7 == 0 else None}


SAMPLE_SQL = f"""{BYTES_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY book) AS n_pages FROM b),
s AS (SELECT book, count(*) AS k, sum(n) AS size FROM i WHERE n_pages <= 15 OR i < 7 OR i BETWEEN (n_pages - 4) // 2 AND (n_pages - 4) // 2 + 3 OR i >= n_pages - 4 GROUP BY book)"""


@query(f"""WITH {SAMPLE_SQL} SELECT book, k || ' pages' AS title, CAST(size AS VARCHAR) AS author, CAST(size AS BIGINT) AS tokens_first, CAST(0 AS BIGINT) AS tokens_again, false AS cached_first, true AS cached_again
FROM s WHERE size % 5 > 0 AND size % 7 > 0""")
def prepass_contexts(spark, sf_dir):
    """Contexts asked for twice: the second time none is paid for; books without a valid answer are left out."""
    pages_, path = bytes_pages(spark, sf_dir), scratch_dir(spark, "contexts")
    first = requests.prepass(spark, pages_, path, asked_about, "context")
    again = requests.prepass(spark, pages_, path, asked_about, "context")
    told = lambda df, suffix: df.select("book", F.col("tokens_in").alias(f"tokens_{suffix}"), F.col("from_cache").alias(f"cached_{suffix}"))
    return first.select("book", "context.title", "context.author").join(told(first, "first"), "book").join(told(again, "again"), "book")


@query(f"""WITH {BYTES_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS i FROM b), s AS (SELECT book, count(*) AS k, sum(n) AS size FROM i WHERE i <= 12 GROUP BY book)
SELECT book, CASE WHEN size % 5 > 0 AND k - size % 3 BETWEEN 1 AND k THEN CAST(k - size % 3 AS INTEGER) END AS cover, CASE WHEN size % 5 > 0 THEN 'by size' ELSE 'nothing to say' END AS reason FROM s WHERE size % 7 > 0""")
def found_covers(spark, sf_dir):
    numbered = bytes_pages(spark, sf_dir).withColumn("page_no", F.row_number().over(Window.partitionBy("book").orderBy(text.natural_key(F.col("stem")))))
    return requests.covers(spark, numbered, scratch_dir(spark, "covers"), asked_about, "cover").select("book", "cover", "reason")


@query(f"""WITH {BYTES_SQL}, p AS (SELECT *, CASE WHEN n = 0 THEN 'blank' WHEN n % 97 = 0 THEN 'fail' ELSE 'ok' END AS o, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS i FROM b),
c AS (SELECT *, CASE WHEN o = 'ok' THEN (n * 32 + 1074) // 100 ELSE 0 END AS micro FROM p),
t AS (SELECT book, count(*) FILTER (WHERE i <= 10 AND o = 'ok') AS ok, count(*) FILTER (WHERE i <= 10 AND o = 'blank') AS blank, count(*) FILTER (WHERE i <= 10 AND o = 'fail') AS fail, CAST(coalesce(sum(micro) FILTER (WHERE i <= 10), 0) AS BIGINT) AS smoke_micro,
  count(*) FILTER (WHERE i > 10 OR o = 'fail') AS remaining, CAST(coalesce(sum(micro) FILTER (WHERE i > 10), 0) AS BIGINT) AS rest_micro, count(*) FILTER (WHERE o <> 'fail') AS good, count(*) FILTER (WHERE i <= 10 AND o <> 'fail') AS tried FROM c GROUP BY book),
e AS (SELECT *, CASE WHEN ok = 0 THEN 4000 ELSE smoke_micro / ok END * remaining AS est FROM t),
s AS (SELECT *, CASE WHEN fail > 0 THEN 'partial' WHEN est <= remaining * 1000 THEN 'full' ELSE 'smoke' END AS status FROM e)
SELECT book, status, ok, blank, fail, remaining, smoke_micro, CAST(round(est / 1000) AS BIGINT) AS est_milli, CASE WHEN status = 'full' THEN rest_micro ELSE 0 END AS full_micro, CASE WHEN status = 'full' THEN good ELSE tried END AS texts FROM s""")
def smoke_gate(spark, sf_dir):
    """Books whose first ten pages tell what the rest costs: some are too dear, of some a page fails, the others are done
    whole, and no page is recognised twice."""

    def answer(image: bytes, prompt: str) -> dict:
        got = recognize.by_content(image, prompt)
        return got | {"md": None, "tokens_in": 0, "tokens_out": 0, "msg": "HTTP 403"} if image and len(image) % 97 == 0 else got

    path = scratch_dir(spark, "smoke")
    told = smoke.smoke_gate(spark, bytes_pages(spark, sf_dir), path, lambda est: est * 1000 <= F.col("remaining"), answer)
    texts = recognize.terminal(recognize.read_results(spark, path)).groupBy("book").agg(F.count("*").alias("texts"))
    micro = lambda c: (F.col(c) * 1_000_000).cast("long")
    return told.join(texts, "book", "left").select("book", "status", "ok", "blank", "fail", "remaining", micro("smoke_usd").alias("smoke_micro"), F.round(F.col("est_full_usd") * 1000).cast("long").alias("est_milli"), micro("full_usd").alias("full_micro"), F.coalesce("texts", F.lit(0)).alias("texts"))


@query(f"""WITH {BYTES_SQL} SELECT doc_id % 3 AS batch, count(*) AS rows, count(*) FILTER (WHERE n > 0) AS ok, count(*) FILTER (WHERE n = 0) AS blank, CAST(sum(n) AS BIGINT) AS tokens_in FROM b GROUP BY 1""")
def progress_events(spark, sf_dir):
    """The events that a listener wrote while three batches of pages, many files each, were recognised as a stream."""
    path = scratch_dir(spark, "progress")
    pages_ = bytes_pages(spark, sf_dir)
    for k in range(3):
        pages_.where(F.substring("stem", F.lit(2), F.length("stem")).cast("long") % 3 == k).write.mode("append").parquet(f"{path}/pages")
        recognize.stream_new_pages(spark, f"{path}/pages", f"{path}/done", f"{path}/checkpoint", "book string, stem string, content binary, prompt string", recognize.by_content, events=f"{path}/events")
    return spark.read.schema(recognize.EVENTS).json(f"{path}/events").select("batch", "rows", "ok", "blank", "tokens_in")


@query("""WITH e AS (SELECT o_custkey, o_orderkey % 3 AS pass, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 50 END AS c FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS book, count(*) FILTER (WHERE c > 0) AS entries, CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) FILTER (WHERE c IS NULL) AS aside FROM e WHERE c IS NULL OR c > 0 GROUP BY o_custkey""")
def ledger_passes(spark, sf_dir):
    """Three passes of a ledger, one of them written three times: it counts once."""
    usd = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise((F.col("o_orderkey") % 50).cast("string"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("book"), usd.alias("cost_usd"), (F.col("o_orderkey") % 3).alias("pass"))
    path = scratch_dir(spark, "ledger")
    for n in (0, 1, 2, 1, 1):
        cost.record_pass(entries.where(F.col("pass") == n).drop("pass"), path, f"pass-{n}")
    ledger = cost.read_ledger(spark, path, "book string, cost_usd string")
    counted = cost.ledger_totals(ledger.where("readable"), ["book"])
    aside = ledger.where("not readable").groupBy("book").agg(F.count("*").alias("aside"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return counted.join(aside, "book", "full").withColumnRenamed("total_usd", "total").select("book", zero("entries"), zero("total"), zero("aside"))


@query(f"""WITH {PAGES_SQL}, h AS (SELECT doc_id, book, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, book, string_split(regexp_replace(md, '\\n\\z', ''), chr(10)) AS l FROM pages_ WHERE md IS NOT NULL)),
n AS (SELECT *, CASE WHEN starts_with(line, '## ') THEN lower(trim(line[4:])) END AS head FROM h),
t AS (SELECT *, coalesce(head IN ('mục lục', 'muc luc'), false) AS is_toc, coalesce(last_value(CASE WHEN starts_with(line, '#') THEN coalesce(head IN ('mục lục', 'muc luc'), false) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS toc,
  first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM n),
a AS (SELECT *, NOT toc AND coalesce(head = lower(book), false) AND (nxt IS NULL OR starts_with(nxt, '## ')) AS demote FROM t)
SELECT CAST(doc_id AS VARCHAR) AS book, md5(coalesce(string_agg(CASE WHEN demote THEN trim(line[4:]) ELSE line END, chr(10) ORDER BY line_no) FILTER (WHERE NOT toc), '') || chr(10)) AS md,
  count(*) FILTER (WHERE is_toc) AS removed, coalesce(list(trim(line[4:]) ORDER BY line_no) FILTER (WHERE demote), []) AS demoted FROM a GROUP BY doc_id""")
def cleaned_books(spark, sf_dir):
    """Marked documents as merged books, cleaned: their texts, contents blocks that went, headings that became text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book"), F.expr(MARKED).alias("md"), "source")
    books = d.select("book", F.col("source").alias("title"), F.lit(None).cast("array<string>").alias("authors"))
    return lines.clean_books(d.select("book", "md"), books).withColumn("md", F.md5("md"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality > 0)")
def bucketed_pending(spark, sf_dir):
    """Pages without a result, pages and results being tables in buckets: neither side is shuffled. Results come twice."""
    name, path = uuid.uuid4().hex, scratch_dir(spark, "buckets")
    pages_ = pages.bucketed(table(spark, sf_dir, "documents").select("doc_id", "source"), f"pages_{name}", ["doc_id"], 8, f"{path}/pages")
    results = table(spark, sf_dir, "labels").withColumn("size", F.col("quality"))
    for odd in (0, 1):
        done = pages.bucketed(results.where(F.col("doc_id") % 2 == odd), f"results_{name}", ["doc_id"], 8, f"{path}/results", "append")
    return pages.pending(pages_, done, ["doc_id"])
