"""The registered queries of the engine's own operators over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import files, text
from quire.operators import attempts, context, cost, lines, packages, pages, summaries
from quire.sources import archive_source, containers, package_sink
from quire.sources.scratch import scratch_dir
from quire.streaming import recognize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Page texts with marks that real texts of these tables lack, derived from doc_id; the same expression in both engines.
MARKED = """
CASE doc_id % 7 WHEN 0 THEN 'Chương ' || CAST(doc_id % 9 + 1 AS STRING) || chr(10) WHEN 1 THEN '##Phần II: Mở' || chr(10)
  WHEN 2 THEN '## mục lục' || chr(10) || 'a 1' || chr(10) || '# Hồi III' || chr(10) WHEN 3 THEN '```markdown' || chr(10)
  WHEN 4 THEN '## ' || source || chr(10) || chr(10) || '## Phần thứ hai' || chr(10) ELSE '' END
|| text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'ref[^1] two[^' || CAST(doc_id % 4 + 1 AS STRING) || ']' || chr(10) || '---' ELSE '' END
|| CASE WHEN doc_id % 5 = 0 THEN chr(10) || '```' || chr(10) || '[^9] literal' || chr(10) || '- - -' || chr(10) || '```' ELSE '' END
|| CASE WHEN doc_id % 7 = 3 THEN chr(10) || '```' || chr(10) || 'tail' ELSE '' END"""

PAGES_SQL = f"pages_ AS (SELECT doc_id, source AS book, 'page_' || CAST(doc_id AS STRING) AS stem, {MARKED} AS md FROM documents)"
KEY_SQL = "list_transform(regexp_extract_all(stem, '([0-9]+)', 1), lambda d: CAST(d AS BIGINT))"
OPEN_SQL, CLOSE_SQL = r"'^```(?:markdown|md)?\s*$'", r"'^```\s*$'"
LINES_SQL = f"""
raw_ AS (SELECT book, stem, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT book, stem, string_split(md, chr(10)) AS l FROM pages_)),
outer_ AS (SELECT *, max(CASE WHEN line_no = 0 THEN regexp_matches(line, {OPEN_SQL}) END) OVER p AS opens,
  max(CASE WHEN line_no > 0 AND regexp_matches(line, {CLOSE_SQL}) THEN line_no END) OVER p AS last_close FROM raw_ WINDOW p AS (PARTITION BY book, stem)),
body_ AS (SELECT book, stem, line_no, line FROM outer_ WHERE NOT opens OR (line_no > 0 AND (last_close IS NULL OR line_no < last_close))),
fence_ AS (SELECT *, regexp_matches(line, {OPEN_SQL}) AS is_fence, coalesce(sum(CAST(regexp_matches(line, {OPEN_SQL}) AS INT)) OVER
  (PARTITION BY book, stem ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM body_)"""
NOTES_SQL = rf"""
notes_ AS (SELECT book, stem, coalesce(max(CASE WHEN NOT is_fence AND NOT in_fence THEN list_max(list_transform(regexp_extract_all(line, '\[\^([0-9]+)\]', 1), lambda d: CAST(d AS BIGINT))) END), 0) AS max_note FROM fence_ GROUP BY book, stem),
offsets_ AS (SELECT book, stem, max_note, CAST(coalesce(sum(max_note) OVER (PARTITION BY book ORDER BY {KEY_SQL}, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS note_offset FROM notes_)"""
NUM_SQL = r"list_transform(range(len(regexp_split_to_array(line, '\[\^[0-9]+\]'))), lambda i: regexp_split_to_array(line, '\[\^[0-9]+\]')[i + 1] || coalesce('[^' || CAST(CAST(regexp_extract_all(line, '\[\^([0-9]+)\]', 1)[i + 1] AS BIGINT) + note_offset AS VARCHAR) || ']', ''))"
HEADING_SQL = text.HEADING.replace("'", "''")


def heading_sql(c: str) -> str:
    return rf"(length({c}) <= 80 AND regexp_matches({c}, '{HEADING_SQL}'))"


ATX_SQL = r"regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '^(#{1,6})([^#\s])', '\1 \2')"
UPGRADE_SQL = f"""CASE WHEN starts_with(s, '## ') AND {heading_sql('trim(s[4:])')} THEN '# ' || trim(s[4:]) WHEN starts_with(s, '## ') OR starts_with(s, '# ') THEN s
  WHEN {heading_sql('s')} THEN '# ' || s ELSE line END"""
CLEAN_SQL = f"""
moved_ AS (SELECT f.book, f.stem, f.line_no, CASE WHEN NOT is_fence AND NOT in_fence AND note_offset > 0 THEN array_to_string({NUM_SQL}, '') ELSE line END AS line FROM fence_ f JOIN offsets_ USING (book, stem)),
heads_ AS (SELECT book, stem, line_no, {UPGRADE_SQL} AS line FROM (SELECT *, {ATX_SQL} AS s FROM moved_)),
fence2_ AS (SELECT *, regexp_matches(line, {OPEN_SQL}) AS is_fence, coalesce(sum(CAST(regexp_matches(line, {OPEN_SQL}) AS INT)) OVER (PARTITION BY book, stem ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM heads_),
clean_ AS (SELECT book, stem, line_no, CASE WHEN NOT is_fence AND NOT in_fence AND regexp_matches(line, '^\\s*-(?:\\s*-){{2,}}\\s*$') THEN '* * *' ELSE line END AS line FROM fence2_)""".replace("\\\\", "\\")
ALL_SQL = f"WITH {PAGES_SQL}, {LINES_SQL}, {NOTES_SQL}, {CLEAN_SQL}"
PAGE = ["book", "stem"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book"), F.expr("'page_' || CAST(doc_id AS STRING)").alias("stem"), F.expr(MARKED).alias("md"))


def fenced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_fences(lines.strip_outer_fence(lines.explode_lines(marked_pages(spark, sf_dir)), PAGE), PAGE)


@query(f"""{ALL_SQL}, per_line AS (SELECT book, count(*) FILTER (WHERE starts_with(line, '# ')) AS h1, count(*) FILTER (WHERE starts_with(line, '## ')) AS h2, sum(length(line)) + count(*) AS n FROM clean_ GROUP BY book),
per_page AS (SELECT book, sum(max_note) AS footnotes, count(*) AS texts FROM offsets_ GROUP BY book), total AS (SELECT book, count(*) AS pages_merged FROM pages_ GROUP BY book)
SELECT book, pages_merged, CAST(n + texts - 2 AS BIGINT) AS body_chars, h1, h2, CAST(footnotes AS BIGINT) AS footnotes FROM total JOIN per_line USING (book) JOIN per_page USING (book)""")
def book_merge_stats(spark, sf_dir):
    return lines.merge_stats(marked_pages(spark, sf_dir))


@query(f"WITH {PAGES_SQL}, {LINES_SQL}, {NOTES_SQL} SELECT * FROM offsets_")
def footnote_offsets(spark, sf_dir):
    return lines.note_offsets(lines.page_notes(marked_pages(spark, sf_dir), PAGE))


@query(f"{ALL_SQL} SELECT book, stem, CAST(line_no AS INTEGER) AS line_no, line FROM moved_")
def footnote_rewrite(spark, sf_dir):
    bodies, _ = lines.renumbered_pages(marked_pages(spark, sf_dir))
    rows = bodies.select(*PAGE, "first_line", F.posexplode(F.split("body", "\n", -1)).alias("n", "line"))
    return rows.select(*PAGE, (F.col("first_line") + F.col("n")).alias("line_no"), "line")


@query(f"WITH {PAGES_SQL}, {LINES_SQL} SELECT book, stem, count(*) AS n_lines, count(*) FILTER (WHERE is_fence) AS fences, count(*) FILTER (WHERE in_fence) AS inside FROM fence_ GROUP BY book, stem")
def fence_parity(spark, sf_dir):
    return fenced_lines(spark, sf_dir).groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.count_if("is_fence").alias("fences"), F.count_if("in_fence").alias("inside"))


@query(rf"WITH {PAGES_SQL}, {LINES_SQL} SELECT book, stem, CAST(line_no AS INTEGER) AS line_no, CASE WHEN NOT is_fence AND NOT in_fence THEN '* * *' ELSE line END AS line FROM fence_ WHERE regexp_matches(line, '^\s*-(?:\s*-){{2,}}\s*$')")
def thematic_breaks(spark, sf_dir):
    fenced = fenced_lines(spark, sf_dir)
    return lines.rewrite_rules(fenced.where(text.is_dash_rule(F.col("line")))).select(*PAGE, "line_no", "line")


@query(f"WITH {PAGES_SQL}, {LINES_SQL} SELECT book, stem, CAST(line_no AS INTEGER) AS line_no, line FROM body_")
def outer_fence_strip(spark, sf_dir):
    return lines.strip_outer_fence(lines.explode_lines(marked_pages(spark, sf_dir)), PAGE)


@query(f"{ALL_SQL}, up_ AS (SELECT book, stem, line_no, line AS old, {UPGRADE_SQL} AS line FROM (SELECT *, {ATX_SQL} AS s FROM body_)) SELECT book, stem, CAST(line_no AS INTEGER) AS line_no, line FROM up_ WHERE line <> old")
def heading_upgrade(spark, sf_dir):
    body = lines.strip_outer_fence(lines.explode_lines(marked_pages(spark, sf_dir)), PAGE)
    return lines.upgrade_headings(body.withColumn("old", F.col("line"))).where("line <> old").select(*PAGE, "line_no", "line")


@query(f"""WITH {PAGES_SQL}, {LINES_SQL}, h AS (SELECT book || stem AS text_id, book, line_no, line, CASE WHEN starts_with(line, '## ') THEN lower(trim(line[4:])) END AS head FROM raw_),
t AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '#') THEN coalesce(head IN ('mục lục', 'muc luc'), false) END IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY line_no), false) AS toc,
  first_value(CASE WHEN trim(line) <> '' THEN line END IGNORE NULLS) OVER (PARTITION BY text_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM h)
SELECT book, CASE WHEN toc THEN 'toc' WHEN head = lower(book) AND (nxt IS NULL OR starts_with(nxt, '## ')) THEN 'demote' ELSE 'keep' END AS action, count(*) AS n_lines FROM t GROUP BY 1, 2""")
def toc_cleanup(spark, sf_dir):
    raw = lines.explode_lines(marked_pages(spark, sf_dir)).withColumn("text_id", F.concat("book", "stem")).withColumn("title", F.col("book")).withColumn("authors", F.lit(None).cast("array<string>"))
    return lines.clean_contents(raw, book="text_id").groupBy("book", "action").agg(F.count("*").alias("n_lines"))


MERGED_SQL = f"""{ALL_SQL}, page_ AS (SELECT book, stem, string_agg(line, chr(10) ORDER BY line_no) AS t FROM clean_ GROUP BY book, stem)
SELECT book, '---' || chr(10) || 'title: "' || book || '"' || chr(10) || 'lang: "vi"' || chr(10) || '---' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY {KEY_SQL}, stem) || chr(10) AS md FROM page_ GROUP BY book"""


def merged_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The marked pages, and their books, which have only a title."""
    p, none = marked_pages(spark, sf_dir), F.lit(None).cast("string")
    return p, p.select("book").distinct().select("book", F.col("book").alias("title"), none.alias("author"), none.alias("lang"), none.alias("year"))


@query(MERGED_SQL)
def merged_books(spark, sf_dir):
    return lines.merge_books(*merged_sources(spark, sf_dir))


@query(f"WITH m_ AS ({MERGED_SQL}) SELECT book, CAST(length(md) AS BIGINT) AS chars FROM m_")
def merged_book_chars(spark, sf_dir):
    """How long each merged book is as it is written, told with the figures of its merge."""
    p, books = merged_sources(spark, sf_dir)
    return lines.merge_stats(p, books=books).select("book", "chars")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS md, count(*) AS n_turns FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def ordered_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where(F.trim("text") != "").withColumnRenamed("text", "line")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "line")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n\n").alias("md"), F.count("*").alias("n_turns"))


STEM_SQL = "'p' || CAST(doc_id % 13 AS STRING) || CASE WHEN doc_id % 3 = 0 THEN '_' || CAST(doc_id AS STRING) WHEN doc_id % 3 = 1 THEN 'x' || lang ELSE '' END"


@query(f"WITH s AS (SELECT source AS book, doc_id, {STEM_SQL} AS stem, CASE WHEN doc_id % 2 = 0 THEN 'PNG' ELSE 'heic' END || CAST(doc_id AS STRING) AS ext FROM documents) SELECT book, doc_id, stem, CAST(row_number() OVER (PARTITION BY book ORDER BY {KEY_SQL}, stem, lower(ext)) AS INTEGER) AS page_no FROM s")
def natural_order_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", F.expr(STEM_SQL).alias("stem"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'PNG' ELSE 'heic' END || CAST(doc_id AS STRING)").alias("ext"))
    return pages.numbered(d).select("book", "doc_id", "stem", "page_no")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality > 0)")
def pending_pages(spark, sf_dir):
    return pages.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumnRenamed("quality", "size"), ["doc_id"])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality > 0) ORDER BY doc_id LIMIT 25")
def pending_limit(spark, sf_dir):
    return pages.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").withColumnRenamed("quality", "size"), ["doc_id"], limit=25, order=[F.col("doc_id")])


PLACED = "CASE doc_id % 11 WHEN 0 THEN '<!-- blank page -->' WHEN 1 THEN '<!-- OCR FAILED (deterministic) — x -->' WHEN 2 THEN '' ELSE text END"


@query(f"WITH p AS (SELECT source AS book, {PLACED} AS md FROM documents) SELECT book, CASE WHEN md = '' THEN 'pending' WHEN starts_with(md, '<!-- OCR FAILED (deterministic)') THEN 'dead' WHEN trim(md) = '<!-- blank page -->' THEN 'blank' ELSE 'ok' END AS status, count(*) AS n FROM p GROUP BY 1, 2")
def page_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.expr(PLACED).alias("md"))
    return d.groupBy("book", attempts.text_status(F.col("md")).alias("status")).agg(F.count("*").alias("n"))


#: Events as attempts: the type decides the message.
MSG = """CASE event_type WHEN 'purchase' THEN CAST(NULL AS STRING) WHEN 'error' THEN 'malformed response line ' || CAST(event_id % 50 AS STRING) || ' | body[:200]=x'
  WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'HTTP 429 too many' ELSE 'empty content (finish_reason=length)' END
  WHEN 'signup' THEN CASE WHEN event_id % 40 = 0 THEN 'HTTP 402 no credit' ELSE 'Request Timed Out' END ELSE CASE WHEN event_id % 10 = 0 THEN 'HTTP 400 data_inspection_failed' WHEN event_id % 10 = 1 THEN 'HTTP 403' ELSE 'HTTP 503' END END"""
ATT_SQL = f"att AS (SELECT user_id, ts, event_id, {MSG} AS msg, CAST(floor(value) AS BIGINT) AS tokens_in, event_id % 17 AS tokens_out FROM events)"
CLASS_SQL = "regexp_replace(CASE WHEN contains(msg, ' | body[:') THEN string_split(msg, ' | body[:')[1] ELSE msg END, '[0-9]+', '#', 'g')"


def attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "ts", "event_id", F.expr(MSG).alias("msg"), F.floor("value").cast("long").alias("tokens_in"), (F.col("event_id") % 17).alias("tokens_out"))


@query(f"""WITH {ATT_SQL}, c AS (SELECT *, {CLASS_SQL} AS class FROM att)
SELECT class, CAST(coalesce((contains(msg, 'HTTP 429') OR contains(msg, 'HTTP 5') OR contains(lower(msg), 'timed out') OR contains(msg, 'empty content') OR contains(msg, 'malformed response')), false) AS BOOLEAN) AS transient,
  coalesce(contains(msg, 'HTTP 400') AND (contains(msg, 'data_inspection_failed') OR contains(msg, 'image format is illegal')), false) AS refused, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def retry_classify(spark, sf_dir):
    a, m = attempt_rows(spark, sf_dir), F.col("msg")
    return a.groupBy(text.error_class(m).alias("class"), F.coalesce(attempts.is_transient(m), F.lit(False)).alias("transient"), F.coalesce(attempts.is_refused(m), F.lit(False)).alias("refused")).agg(F.count("*").alias("n"))


@query(f"""WITH {ATT_SQL}, a AS (SELECT *, row_number() OVER w AS attempt FROM att WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN contains(msg, 'empty content') OR contains(msg, 'malformed response') THEN {CLASS_SQL} END AS class FROM a WHERE attempt <= 5),
c AS (SELECT *, coalesce(class = lag(class) OVER w, false) AS again, sum(tokens_in) OVER w AS ti, sum(tokens_out) OVER w AS tout FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN msg IS NULL THEN 'ok' WHEN contains(msg, 'HTTP 400') AND contains(msg, 'data_inspection_failed') OR again THEN 'dead'
  WHEN attempt = 5 OR NOT (contains(msg, 'HTTP 429') OR contains(msg, 'HTTP 5') OR contains(lower(msg), 'timed out') OR contains(msg, 'empty content') OR contains(msg, 'malformed response')) THEN 'fail' END AS outcome FROM c),
e AS (SELECT user_id, min(attempt) FILTER (WHERE outcome IS NOT NULL) AS ended, max(attempt) AS last FROM d GROUP BY user_id)
SELECT d.user_id, CAST(d.attempt AS INTEGER) AS attempt, coalesce(d.outcome, 'open') AS outcome, CAST(d.ti AS BIGINT) AS tokens_in, CAST(d.tout AS BIGINT) AS tokens_out FROM d JOIN e ON d.user_id = e.user_id AND d.attempt = coalesce(e.ended, e.last)""")
def early_abort(spark, sf_dir):
    return attempts.outcomes(attempt_rows(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query(f"""WITH {ATT_SQL}, c AS (SELECT user_id, ts, event_id, {CLASS_SQL} AS class FROM att),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, class ORDER BY ts, event_id) AS island FROM c)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, class, island, count(*) AS n FROM i WHERE class IS NOT NULL GROUP BY 1, 2, 3) GROUP BY user_id""")
def error_streaks(spark, sf_dir):
    return attempts.longest_streaks(attempt_rows(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query(f"""WITH {ATT_SQL}, s AS (SELECT user_id % 50 AS lane, coalesce(max(contains(msg, 'HTTP 402')) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM att)
SELECT lane, count(*) FILTER (WHERE skipped) AS skipped, count(*) AS total FROM s GROUP BY lane""")
def breaker_skip(spark, sf_dir):
    a = attempt_rows(spark, sf_dir).withColumn("lane", F.col("user_id") % 50)
    s = attempts.skipped_by_breaker(a, ["lane"], ["ts", "event_id"], attempts.is_unpaid(F.col("msg")))
    return s.groupBy("lane").agg(F.count_if("skipped").alias("skipped"), F.count("*").alias("total"))


@query("SELECT event_type, CAST(sum(CAST(power(2.0, event_id % 4) + 0.5 * (event_id % 4) AS DOUBLE)) AS DOUBLE) AS waited FROM events GROUP BY event_type")
def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(attempts.wait_seconds(F.col("event_id") % 4)).alias("waited"))


@query("""WITH r AS (SELECT l_shipmode_, tin, tout, CASE m WHEN 1 THEN 3 WHEN 2 THEN 250 ELSE 32 END AS pi, CASE m WHEN 1 THEN 13 WHEN 2 THEN 1000 ELSE 128 END AS po
  FROM (SELECT l_returnflag AS l_shipmode_, CAST(l_partkey AS BIGINT) AS tin, CAST(l_suppkey AS BIGINT) AS tout, l_orderkey % 4 AS m FROM lineitem))
SELECT l_shipmode_ AS flag, CAST(sum(tin * pi + tout * po) AS BIGINT) AS cost_e8, count(*) AS n FROM r GROUP BY 1""")
def price_lookup(spark, sf_dir):
    model = F.when(F.col("l_orderkey") % 4 == 1, cost.PRICES[1][0]).when(F.col("l_orderkey") % 4 == 2, cost.PRICES[2][0]).when(F.col("l_orderkey") % 4 == 3, "unknown/model").otherwise(cost.DEFAULT_MODEL)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"), model.alias("model"))
    known = cost.priced(li, cost.price_table(spark))
    exact = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) * 100
    return known.groupBy("flag").agg(F.sum(exact.cast("long")).alias("cost_e8"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS entries, CAST(sum(c) AS BIGINT) AS total_micro FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 1000 END AS c FROM orders) WHERE c > 0 GROUP BY o_custkey")
def ledger_total(spark, sf_dir):
    usd = F.when(F.col("o_orderkey") % 5 == 0, F.lit("0")).when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.concat((F.col("o_orderkey") / 1000).cast("decimal(18,3)").cast("string"), F.lit("000")))
    t = cost.ledger_totals(table(spark, sf_dir, "orders").select("o_custkey", usd.alias("cost_usd")), ["o_custkey"])
    return t.select("o_custkey", "entries", (F.col("total_usd") * 1_000_000).cast("long").alias("total_micro"))


@query("SELECT source, CAST(count(*) FILTER (WHERE NOT done) AS BIGINT) AS todo, CAST(count(*) FILTER (WHERE done) AS BIGINT) AS skipped, count(*) AS total, CAST(4 * count(*) FILTER (WHERE NOT done) AS BIGINT) AS estimate_milli FROM (SELECT d.source, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) GROUP BY source")
def dry_run_estimate(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(done, "doc_id", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return cost.estimates(d, ["source"]).withColumn("estimate_milli", (F.col("estimate_usd") * 1000).cast("long")).drop("estimate_usd")


@query("SELECT source, CAST(round(CASE WHEN ok = 0 THEN 0.004 ELSE 0.01 END * remaining * 1000) AS BIGINT) AS estimate_milli FROM (SELECT source, count(*) FILTER (WHERE doc_id % 2 = 1 AND source <> 'src1') AS ok, count(*) FILTER (WHERE doc_id % 2 = 0) AS remaining FROM documents GROUP BY source)")
def smoke_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if((F.col("doc_id") % 2 == 1) & (F.col("source") != "src1")).alias("ok"), F.count_if(F.col("doc_id") % 2 == 0).alias("remaining"))
    spent = (F.col("ok").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(18,2)")
    return d.select("source", F.round(cost.smoke_estimate(spent, F.col("ok"), F.col("remaining")) * 1000).cast("long").alias("estimate_milli"))


@query("""WITH n AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM documents)
SELECT source, lang, doc_id FROM n WHERE n <= 15 OR i < 7 OR (i >= (n - 4) // 2 AND i < (n - 4) // 2 + 4) OR i >= n - 4""")
def context_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.concat("source", "lang").alias("b"))
    return pages.context_sample(d, "b", [F.col("doc_id")]).drop("b")


SIZED = (
    "p_brand AS book", "p_partkey", "CASE WHEN p_partkey % 97 = 5 THEN 300 WHEN p_size % 9 = 0 THEN 1600 ELSE 800 END AS w",
    "CASE WHEN p_partkey % 97 = 5 THEN 200 ELSE 1200 END AS h", "p_partkey % 31 = 0 AS reset",
)


@query(f"""WITH s AS (SELECT {', '.join(SIZED)} FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY p_partkey) AS page_no FROM s WHERE greatest(w, h) >= 400),
c AS (SELECT *, page_no = 1 OR coalesce(w > h, false) AS centre FROM f), g AS (SELECT *, sum(CAST(centre OR reset AS INT)) OVER (PARTITION BY book ORDER BY page_no) AS grp FROM c),
n AS (SELECT *, sum(CAST(NOT centre AS INT)) OVER (PARTITION BY book, grp ORDER BY page_no) AS nth FROM g)
SELECT book, p_partkey, CAST(page_no AS INTEGER) AS page_no, CASE WHEN centre THEN 'center' WHEN nth % 2 = 1 THEN 'right' ELSE 'left' END AS spread FROM n""")
def spread_cadence(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr(*SIZED).where(F.greatest("w", "h") >= 400)
    numbered = p.withColumn("page_no", F.row_number().over(Window.partitionBy("book").orderBy("p_partkey")))
    return pages.spread_cadence(numbered).select("book", "p_partkey", "page_no", "spread")


@query("SELECT event_id, props::JSON ->> 'k' AS k, props IS NOT NULL AND json_valid(props) AS valid FROM events")
def json_payload_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))
    return e.select("event_id", F.get_json_object(text.json_object(fenced), "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://drive.google.com/file/d/F' || page_id || '/view' WHEN 1 THEN 'https://drive.google.com/drive/folders/D' || page_id WHEN 2 THEN 'https://drive.google.com/open?id=Q' || page_id WHEN 3 THEN 'https://drive.google.com/uc?id=U' || page_id ELSE url END AS url FROM pages)
SELECT page_id, page_id % 5 < 4 AS is_drive, page_id % 5 IN (1, 2, 3) AS is_folder, CASE WHEN page_id % 5 < 4 THEN coalesce(nullif(regexp_extract(url, '/file/d/([\w-]+)', 1), ''), nullif(regexp_extract(url, '/folders/([\w-]+)', 1), ''), nullif(regexp_extract(url, '[?&]id=([^&#]+)', 1), '')) END AS id FROM u""")
def drive_ids(spark, sf_dir):
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    base = F.lit("https://drive.google.com/")
    url = F.when(k == 0, F.concat(base, F.lit("file/d/F"), n, F.lit("/view"))).when(k == 1, F.concat(base, F.lit("drive/folders/D"), n)).when(k == 2, F.concat(base, F.lit("open?id=Q"), n)).when(k == 3, F.concat(base, F.lit("uc?id=U"), n)).otherwise(F.col("url"))
    u = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    c = F.col("url")
    return u.select("page_id", files.is_drive(c).alias("is_drive"), files.is_drive_folder(c).alias("is_folder"), F.when(files.is_drive(c), files.drive_id(c)).alias("id"))


@query(r"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS INTEGER) AS n_links, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS title FROM pages""")
def page_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("n_links"), text.xml_escape(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@query(r"""SELECT doc_id, CASE WHEN slug = '' THEN 'book' ELSE slug END AS slug FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝđĐ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYdD'), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM documents)""")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.latin_slug(F.col("text")).alias("slug"))


@query(r"""SELECT doc_id, CASE WHEN slug = '' THEN 'book' ELSE slug END AS slug FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝđĐ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYdD'), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS slug FROM documents)""")
def text_slugs(spark, sf_dir):
    """slugify() over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(r"""SELECT p_partkey, '---' || chr(10) || 'title: "' || replace(replace(p_name || '\' || p_type, '\', '\\'), '"', '\"') || '"' || chr(10) || CASE WHEN p_partkey % 3 > 0 THEN 'author: "' || p_brand || '"' || chr(10) ELSE '' END || 'lang: "vi"' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'date: "' || p_size || '"' || chr(10) ELSE '' END || '---' || chr(10) AS fm FROM part""")
def front_matter(spark, sf_dir):
    odd = F.col("p_partkey") % 2 == 0
    fm = text.front_matter(F.concat("p_name", F.lit("\\"), "p_type"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).otherwise(""), F.lit("vi"), F.when(odd, F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", fm.alias("fm"))


@query("""WITH i AS (SELECT CASE WHEN doc_id % 6 = 1 THEN source || '/' || doc_id ELSE source || CAST(doc_id % 6 AS STRING) END AS folder, CASE WHEN doc_id % 6 = 0 THEN 'jpg' WHEN doc_id % 6 = 1 THEN ['zip', 'rar', 'mobi', 'pdf'][doc_id // 6 % 4 + 1] ELSE lang END AS t FROM documents),
c AS (SELECT folder, t, count(*) AS n FROM i GROUP BY folder, t)
SELECT folder, CAST(sum(n) AS BIGINT) AS n_files, CASE WHEN bool_and(t IN ('jpg', 'png')) THEN 'images' WHEN sum(n) = 1 AND min(t) IN ('zip', 'rar', 'mobi', 'pdf') THEN min(t) ELSE 'mixed' END AS route, string_agg(t || '×' || n, ', ' ORDER BY t || '×' || n) AS histogram FROM c GROUP BY folder""")
def folder_classify(spark, sf_dir):
    """All documents as files; every sixth is an archive in a folder of its own."""
    k, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("zip", "rar", "mobi", "pdf"))), F.expr("CAST(doc_id div 6 % 4 + 1 AS INT)"))
    folder = F.when(k == 1, F.concat("source", F.lit("/"), n)).otherwise(F.concat("source", k.cast("string")))
    return pages.classify_folders(table(spark, sf_dir, "documents").select(folder.alias("folder"), F.when(k == 0, "jpg").when(k == 1, kind).otherwise(F.col("lang")).alias("file_type")))


@query("SELECT count(*) FILTER (WHERE s = 'OK') AS ok, count(*) FILTER (WHERE s = 'TINY') AS tiny, count(*) FILTER (WHERE s = 'BADZIP') AS badzip, count(*) FILTER (WHERE s = 'MISSING') AS missing, count(*) AS total FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN 'MISSING' WHEN n_chars < 10240 THEN 'TINY' WHEN doc_id % 4 = 0 THEN 'BADZIP' ELSE 'OK' END AS s FROM documents)")
def verify_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return packages.verify_summary(d.select(packages.archive_status(F.col("doc_id") % 9 != 0, F.col("n_chars"), F.col("doc_id") % 4 != 0).alias("status")))


LOG = "'t ' || event_type || CASE WHEN event_id % 6 = 0 THEN ' 429 Rate-Limit 0.429' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN ' 1 trang DEAD placeholder, ' || CAST(event_id % 8 AS STRING) || ' trang DEAD placeholder' ELSE '' END"


@query(f"""WITH l AS (SELECT user_id % 200 AS slug, event_id, {LOG} AS t FROM events),
d AS (SELECT slug, arg_max(event_id % 8, event_id) FILTER (WHERE event_id % 5 = 0) AS dead, CAST(2 * count(*) FILTER (WHERE event_id % 6 = 0) AS BIGINT) AS n429 FROM l GROUP BY slug)
SELECT slug, n429, CASE WHEN slug % 17 = 0 THEN 'STOP(402)' WHEN slug % 13 = 0 THEN 'WARN(init-fail)' WHEN slug % 11 = 0 THEN 'WARN(no-epub)' WHEN coalesce(dead, 0) > 0 THEN 'DONE(dead=' || dead || ')' ELSE 'DONE' END AS label FROM d""")
def batch_labels(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("slug"), F.col("event_id").alias("log_no"), F.expr(LOG).alias("text"))
    counted = logs.groupBy("slug").agg(F.sum(attempts.count_429(F.col("text"))).alias("n429"))
    s = F.col("slug")
    label = attempts.book_label(s % 11 != 0, s % 13 == 0, s % 17 == 0, F.col("dead"))
    return attempts.last_dead(logs, ["slug"]).join(counted, "slug").select("slug", "n429", label.alias("label"))


@query("SELECT count(*) AS books, count(*) FILTER (WHERE secs > 100) AS done, CAST(sum(secs) AS BIGINT) AS total_secs, max(secs) AS wall, (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)) AS not_started FROM (SELECT o_custkey, CAST(count(*) * 10 AS BIGINT) AS secs FROM orders GROUP BY o_custkey)")
def batch_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    per = o.groupBy("o_custkey").agg((F.count("*") * 10).alias("secs"))
    idle = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(o, "o_custkey", "left_anti").agg(F.count("*").alias("not_started"))
    return per.agg(F.count("*").alias("books"), F.count_if(F.col("secs") > 100).alias("done"), F.sum("secs").alias("total_secs"), F.max("secs").alias("wall")).crossJoin(idle)  # one row each


@query("""WITH b AS (SELECT c_custkey, CAST(c_custkey AS STRING) AS slug, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE c_name END AS title FROM customer),
x AS (SELECT CAST(o_custkey AS STRING) AS slug, min(CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END) AS t, min(o_orderstatus) AS a FROM orders GROUP BY 1)
SELECT b.slug, CASE WHEN b.title = b.slug AND coalesce(x.t, '') <> '' THEN x.t ELSE b.title END AS title, CASE WHEN b.title = b.slug AND coalesce(x.t, '') <> '' THEN coalesce(nullif(x.a, ''), '?') ELSE '?' END AS author FROM b LEFT JOIN x USING (slug)""")
def metadata_backfill(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    books = table(spark, sf_dir, "customer").select(key.alias("slug"), F.when(F.col("c_custkey") % 2 == 0, key).otherwise(F.col("c_name")).alias("title"), F.lit("?").alias("author"), none.alias("year"), none.alias("translator"))
    ctx = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("slug")).agg(F.min(F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.col("o_orderpriority"))).alias("title"), F.min("o_orderstatus").alias("author")).withColumn("year", none).withColumn("translator", none)
    return pages.backfill(books, ctx).select("slug", "title", "author")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'user/' || c_name END, s.s_name, NULL) AS cover FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey")
def cover_resolution(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    own = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("user/"), "c_name")).alias("v"))
    ctx = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return pages.prefer(c.select("c_custkey"), [(own, "v"), (ctx, "s_name")], "c_custkey", "cover")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN p_brand || ' ' || lpad(CAST(p_size - 1 AS VARCHAR), CASE WHEN p_size - 1 < 10 THEN 2 ELSE 3 END - CASE WHEN p_size - 1 BETWEEN 10 AND 99 THEN 1 ELSE 0 END, '0') ELSE CAST(p_partkey AS VARCHAR) END AS title, list_transform(list_filter(list_transform(string_split(p_size || ', x,' || p_partkey, ','), lambda x: trim(x)), lambda x: regexp_matches(x, '^-?[0-9]{1,9}$')), lambda x: CAST(x AS INTEGER)) AS resets, CASE WHEN p_size BETWEEN 1 AND 20 THEN p_size ELSE 1 END AS cover FROM part")
def image_book_metadata(spark, sf_dir):
    k, s = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    title = text.derived_title(F.when(k == 0, F.col("p_name")).otherwise(""), F.when(k == 1, F.col("p_brand")), F.col("p_size") - 1, s)
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), text.spread_resets(F.concat(F.col("p_size").cast("string"), F.lit(", x,"), s)).alias("resets"), context.clamped_cover(F.col("p_size"), F.lit(20)).alias("cover"))


@query("SELECT c_custkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST(CAST('0x' || h[17] AS INTEGER) & 3 AS INTEGER) + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM (SELECT c_custkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('quire:book:' || c_name)) AS h FROM customer)")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.stable_id(F.concat(F.lit("quire:book:"), "c_name")).alias("id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size % 5 > 0)")
def manifest_integrity(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.lit("b").alias("book"), F.col("l_partkey").cast("string").alias("href"), "l_orderkey", "l_linenumber")
    names = table(spark, sf_dir, "part").where("p_size % 5 > 0").select(F.lit("b").alias("book"), F.concat(F.lit("OEBPS/"), F.col("p_partkey").cast("string")).alias("name"))
    return packages.missing_hrefs(m, names).select("l_orderkey", "l_linenumber")


@query("SELECT source, arg_max(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents GROUP BY source")
def first_wins(spark, sf_dir):
    return pages.first_wins(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.desc("doc_id")]).select("source", "doc_id")


@query("SELECT doc_id, CASE ext WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'tiff' THEN 'image/jpeg' ELSE 'image/jpeg' END AS media, ext IN ('png', 'jpg') AND NOT sidecar AS taken FROM (SELECT doc_id, ['png', 'webp', 'tiff', 'jpg'][doc_id % 4 + 1] AS ext, doc_id % 7 = 0 AS sidecar FROM documents)")
def scan_names(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ("png", "webp", "tiff", "jpg"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "._p").otherwise("p"), F.col("doc_id").cast("string"), F.lit("."), F.upper(ext))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    e = files.extension(F.col("name"))
    return d.select("doc_id", files.media_type(e).alias("media"), (e.isin(*files.IMPORT_EXTS) & ~files.is_sidecar(F.col("name"))).alias("taken"))


@query("SELECT p_partkey, 'png' AS kind, CAST(p_size + 100 AS INTEGER) AS w, CAST(p_size + 700 AS INTEGER) AS h FROM part")
def magic_dims(spark, sf_dir):
    """Headers made from part sizes: type, width and height of each."""
    w, h = (F.lpad(F.hex(F.col("p_size") + F.lit(n)), 8, "0") for n in (100, 700))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), w, h))
    p = table(spark, sf_dir, "part").select("p_partkey", png.alias("content"))
    return p.select("p_partkey", files.sniff(F.col("content")).alias("kind"), files.image_size(F.col("content")).alias("size")).select("p_partkey", "kind", "size.w", "size.h")


#: Answers of a model about books, made from customers.
ANSWER = """'Sure:' || chr(10) || '{"title": "' || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END || '"' || CASE WHEN c_custkey % 2 = 0 THEN ', "author": "' || c_mktsegment || '"' ELSE '' END
|| CASE WHEN c_custkey % 4 = 0 THEN ', "year": 1990' ELSE '' END || ', "pages_per_image": "' || CASE c_custkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN '2' ELSE '1' END || '", "lang": "' || CASE WHEN c_custkey % 5 = 0 THEN 'ja' ELSE 'vi' END
|| '", "content_type": "' || CASE WHEN c_custkey % 7 = 0 THEN 'Verse' ELSE 'prose' END || '", "terminology": ["t' || CAST(c_custkey AS STRING) || '", ""]}'"""
_Q = lambda s: s.replace("'", "''")


@query(f"""SELECT c_custkey, '{context.HEAD}' || chr(10) || '{_Q(context.RULES[0])}' || chr(10) || '{_Q(context.RULES[1])}' || chr(10) || CASE WHEN c_custkey % 7 = 0 THEN '{_Q(context.VERSE_RULE)}' || chr(10) ELSE '' END
  || 'Sách: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' — ' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ' (1990)' ELSE '' END || chr(10) || '{context.PER_IMAGE}' || CASE WHEN c_custkey % 3 = 1 THEN '2' ELSE '1' END
  || CASE WHEN c_custkey % 3 <> 1 THEN '' WHEN c_custkey % 5 = 0 THEN chr(10) || 'Double pages, right to left: 2 pages in each image, the right one first.' ELSE chr(10) || 'Double pages, left to right: 2 pages in each image, the left one first.' END
  || chr(10) || '{context.TERMS}' || 't' || c_custkey AS block, CAST(2 AS INTEGER) AS n_terms FROM customer WHERE c_custkey % 11 <> 0""")
def context_block(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", context.parse(F.expr(ANSWER)).alias("c")).where("c is not null")
    return c.select("c_custkey", context.render(F.col("c")).alias("block"), F.size("c.terminology").alias("n_terms"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 AND p_size BETWEEN 1 AND 20 THEN p_size END AS cover, substr(CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE 'no answer ' || p_name END, 1, 200) AS reason FROM part")
def cover_answers(spark, sf_dir):
    answer = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit('{"cover_page": '), F.col("p_size").cast("string"), F.lit(', "reason": "'), "p_name", F.lit('"}'))).otherwise(F.concat(F.lit("no answer "), "p_name"))
    p = table(spark, sf_dir, "part").select("p_partkey", answer.alias("a"))
    return p.select("p_partkey", context.cover_page(F.col("a"), F.lit(20)).alias("cover"), context.safe_reason(F.col("a")).alias("reason"))


@query("SELECT c_custkey, ['A', c_name, c_mktsegment] AS authors, to_base64(encode(repeat(c_name, 5))) AS encoded, 'HTTP # ' || substr(c_mktsegment, 1, 113) AS reason FROM customer")
def text_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    msg = F.concat(F.lit("HTTP 503 "), "c_mktsegment", F.lit("\nmore | body[:20]=x"))
    return c.select("c_custkey", text.split_authors(F.concat(F.lit("A; "), "c_name", F.lit(", ,"), "c_mktsegment")).alias("authors"), text.plain_base64(F.encode(F.repeat("c_name", 5), "UTF-8")).alias("encoded"), attempts.dead_reason(msg).alias("reason"))


PATHS = ("a/b.mobi", "x.AZW3", "c.cbz", "d.d/e.zip", "folder", "https://drive.google.com/file/d/x", "e.txt", "p.webp")


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'mobi' WHEN 1 THEN 'mobi' WHEN 2 THEN 'archive' WHEN 3 THEN 'archive' WHEN 4 THEN 'folder' WHEN 5 THEN 'drive' END AS reader, CASE WHEN doc_id % 8 = 7 THEN 'image/webp' ELSE 'image/png' END AS mime, {list(PATHS)}[doc_id % 8 + 1] AS path FROM documents")
def input_routes(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % 8 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return d.select("doc_id", "path", files.reader_for(F.col("path")).alias("reader"), files.upload_mime(files.extension(F.col("path"))).alias("mime"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'F' || page_id WHEN 1 THEN 'L' || page_id END AS token, ['A' || page_id, 'B'] AS listed FROM pages")
def drive_pages(spark, sf_dir):
    n = F.col("page_id").cast("string")
    form = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<input name="confirm" value="F'), n, F.lit('">'))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('<a href="/uc?confirm=L'), n, F.lit('&amp;id=x">'))).otherwise("<p>")
    links = F.concat(F.lit('<a href="/file/d/A'), n, F.lit('/view"><a href="/file/d/B/view"><a href="/file/d/A'), n, F.lit('/edit">'))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(form, links).alias("html"))
    return p.select("page_id", files.confirm_token(F.col("html")).alias("token"), files.listed_files(F.col("html")).alias("listed"))


@query("""SELECT event_id, '{"event":"' || event_type || '","user":' || user_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE ',"note":"' || event_type || '"' END || '}' AS line FROM events""")
def event_lines(spark, sf_dir):
    note = F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("note")
    return table(spark, sf_dir, "events").select("event_id", summaries.event_line(F.col("event_type"), F.col("user_id").alias("user"), note).alias("line"))


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'done' ELSE 'page_ok' END AS k FROM events),
l AS (SELECT user_id, max(event_id) FILTER (WHERE k = 'start') AS s, max(event_id) FILTER (WHERE k = 'done') AS d FROM e GROUP BY user_id)
SELECT user_id, coalesce(d, 0) AS ok, CAST(0 AS BIGINT) AS blank, coalesce(d % 5, 0) AS fail, coalesce(s % 3, 0) AS skipped, coalesce(s, 0) AS total FROM l""")
def run_summaries(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").otherwise("page_ok")
    n = F.col("event_id")
    payload = F.when(kind == "start", F.to_json(F.struct(n.alias("total"), (n % 3).alias("skipped")))).otherwise(F.to_json(F.struct(n.alias("ok"), (n % 5).alias("fail"))))
    e = table(spark, sf_dir, "events").select("user_id", n.alias("seq"), kind.alias("event"), payload.alias("payload"))
    return summaries.run_summary(e, ["user_id"]).drop("cost_usd")


@query(f"""WITH {ATT_SQL}, o AS (SELECT user_id % 20 AS book, tokens_in, tokens_out, CASE WHEN msg IS NULL THEN 'ok' WHEN contains(msg, 'empty content') THEN 'blank' WHEN contains(msg, 'HTTP 400') THEN 'dead' ELSE 'fail' END AS o FROM att)
SELECT book, count(*) FILTER (WHERE o = 'ok') AS ok, count(*) FILTER (WHERE o = 'fail') AS fail, count(*) FILTER (WHERE o = 'blank') AS blank, count(*) FILTER (WHERE o = 'dead') AS dead, count(*) AS total, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(count(*) FILTER (WHERE o IN ('fail', 'dead')) AS INTEGER) AS n_failures FROM o GROUP BY book""")
def batch_summary(spark, sf_dir):
    m = F.col("msg")
    outcome = F.when(m.isNull(), "ok").when(m.contains("empty content"), "blank").when(m.contains("HTTP 400"), "dead").otherwise("fail")
    a = attempt_rows(spark, sf_dir).withColumn("book", F.col("user_id") % 20).withColumn("page", F.col("event_id").cast("string")).withColumn("outcome", outcome)
    return attempts.batch_summary(a).withColumn("n_failures", F.size("failures")).drop("failures")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_suppkey % 4 > 0)")
def spine_integrity(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.lit("b").alias("book"), F.col("l_suppkey").cast("string").alias("idref"), "l_orderkey", "l_linenumber")
    ids = table(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select(F.lit("b").alias("book"), F.col("s_suppkey").cast("string").alias("id"))
    return packages.dangling_idrefs(refs, ids).select("l_orderkey", "l_linenumber")


def part_entries(spark: SparkSession, sf_dir: str, wanted: str = "true") -> DataFrame:
    """The members of a fixed-layout package for each wanted brand, its parts being the page images."""
    p = table(spark, sf_dir, "part").selectExpr(*SIZED).where(wanted)
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), *(F.lpad(F.hex(c), 8, "0") for c in ("w", "h")))
    images = p.select("book", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("stem"), F.lit("png").alias("ext"), F.unhex(head).alias("content"))
    none = F.lit(None).cast("string")
    books = p.select("book").distinct().select("book", F.col("book").alias("title"), none.alias("author"), F.lit("ja").alias("lang"), F.lit("2024-01-01T00:00:00Z").alias("modified"), F.lit(True).alias("rtl"))
    return packages.package_entries(images, books)


def packaged_parts(spark: SparkSession, sf_dir: str, wanted: str = "true") -> DataFrame:
    return packages.zip_books(part_entries(spark, sf_dir, wanted))


@query("SELECT DISTINCT p_brand AS book, true AS valid, CAST(0 AS INTEGER) AS n_errors FROM part")
def package_validation(spark, sf_dir):
    return packages.validate(packages.zip_pieces(part_entries(spark, sf_dir))).select("book", "valid", F.size("errors").alias("n_errors"))


@query(f"""WITH s AS (SELECT {', '.join(SIZED)} FROM part), f AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY p_partkey) AS n FROM s WHERE greatest(w, h) >= 400)
SELECT book, 'OEBPS/scans/' || lpad(CAST(n AS VARCHAR), 5, '0') || '.png' AS name, CAST(n AS INTEGER) AS page_no FROM f""")
def packaged_images(spark, sf_dir):
    return containers.archived_images(packaged_parts(spark, sf_dir), ["book"]).select("book", "name", "page_no")


@query(f"""WITH s AS (SELECT {', '.join(SIZED)} FROM part), f AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY p_partkey) AS n FROM s WHERE greatest(w, h) >= 400)
SELECT book, 'OEBPS/scans/' || lpad(CAST(n AS VARCHAR), 5, '0') || '.png' AS name, CAST(24 AS BIGINT) AS size, CAST(n AS INTEGER) AS page_no FROM f""")
def package_file_images(spark, sf_dir):
    """Packages written as files by the sink, and their images read back by ranges, several tasks to a file."""
    path = scratch_dir(spark, "packages")
    package_sink.write_packages(part_entries(spark, sf_dir), path)
    members = archive_source.read_archives(spark, path, splitBytes=1 << 14)
    return containers.numbered_images(members.withColumn("book", package_sink.book_of(F.col("path"))), ["book"]).select("book", "name", "size", "page_no")


@query("SELECT DISTINCT p_brand AS book, true AS valid, CAST(0 AS INTEGER) AS n_errors FROM part")
def package_file_validation(spark, sf_dir):
    path = scratch_dir(spark, "packages")
    package_sink.write_packages(part_entries(spark, sf_dir), path)
    return packages.validate_files(spark, path).select("book", "valid", F.size("errors").alias("n_errors"))


@query("SELECT p_partkey, CAST(1 AS INTEGER) AS record_no, CAST(1 AS INTEGER) AS page_no, 'png' AS ext, CAST(1208 AS INTEGER) AS n_bytes FROM part WHERE p_partkey % 2 = 0")
def pdb_pages(spark, sf_dir):
    """Containers of two records, a name and an image; every other image is too small to be a page."""
    u32 = lambda c: F.concat(F.lpad(F.hex(c), 8, "0"), F.lit("0" * 8))
    image = F.concat(F.lit("89504E470D0A1A0A"), F.when(F.col("p_partkey") % 2 == 0, F.repeat(F.lit("00"), 1200)).otherwise(F.repeat(F.lit("00"), 10)))
    whole = F.concat(F.lit("00" * 76), F.lit("0002"), u32(F.lit(94)), u32(F.octet_length("p_name") + 94), F.hex("p_name"), image)
    c = table(spark, sf_dir, "part").select("p_partkey", F.unhex(whole).alias("content"))
    return containers.pdb_images(c, ["p_partkey"]).select("p_partkey", "record_no", "page_no", "ext", F.length("record").alias("n_bytes"))


@query(f"""WITH {PAGES_SQL}, raw_ AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS l FROM pages_ WHERE md IS NOT NULL)),
f_ AS (SELECT *, starts_with(line, '```') AS is_fence, coalesce(sum(CAST(starts_with(line, '```') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM raw_),
h_ AS (SELECT *, starts_with(line, '# ') AND NOT is_fence AND NOT in_fence AS head FROM f_),
n_ AS (SELECT doc_id, count(*) FILTER (WHERE head) AS heads, min(line_no) FILTER (WHERE head) AS first_head, min(line_no) FILTER (WHERE regexp_matches(line, '\\S')) AS first_text FROM h_ GROUP BY doc_id)
SELECT doc_id, CAST(4 + heads + CASE WHEN heads = 0 OR first_text < first_head THEN 1 ELSE 0 END AS BIGINT) AS members FROM n_""")
def reflowable_members(spark, sf_dir):
    """A package for each whole marked text; its members are the sections and four that every package has."""
    d = table(spark, sf_dir, "documents")
    merged = d.select(F.col("doc_id").cast("string").alias("book"), F.col("source").alias("title"), F.expr(MARKED).alias("md"))
    m = containers.zip_members(packages.build_reflowable(merged), ["book"])
    return m.where("crc_ok").groupBy(F.col("book").cast("long").alias("doc_id")).agg(F.count("*").alias("members"))


@query("SELECT 'p' || doc_id AS stem, source AS book, CASE WHEN coalesce(text, '') = '' THEN 'blank' ELSE 'ok' END AS outcome, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS tokens_in FROM documents")
def recognized_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("stem"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit("").alias("prompt"))
    return recognize.recognize(d, recognize.by_content).select("stem", "book", "outcome", "tokens_in")
