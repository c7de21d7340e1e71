"""Explicit schemas of the engine's relations; nothing is inferred."""

BOOKS = "slug STRING, title STRING, author STRING, translator STRING, lang STRING, year STRING"
IMAGE_BOOKS = "slug STRING, title STRING, author STRING, lang STRING, year STRING, series STRING, series_index INT, subject STRING, publisher STRING, description STRING, rtl BOOLEAN"
PAGE_IMAGES = "book STRING, stem STRING, ext STRING, name STRING, size BIGINT, content BINARY"
PAGE_TEXT = "book STRING, stem STRING, md STRING"
ATTEMPTS = "book STRING, page STRING, attempt_no INT, start_seq BIGINT, msg STRING, finish STRING, tokens_in BIGINT, tokens_out BIGINT"
LEDGER = "book STRING, ts TIMESTAMP, stage STRING, pages_ok BIGINT, tokens_in BIGINT, tokens_out BIGINT, cost_usd STRING"
CONTEXT = "title STRING, author STRING, translator STRING, publisher STRING, year STRING, pages_per_image STRING, cover_page STRING, content_type STRING, lang STRING, table_of_contents ARRAY<STRUCT<title: STRING, page: INT>>, proper_names ARRAY<STRUCT<seen: STRING, canonical: STRING>>, terminology ARRAY<STRING>, layout_notes STRING, footnote_convention STRING, ocr_pitfalls ARRAY<STRING>"
MANIFEST = "book STRING, id STRING, href STRING, media_type STRING, properties STRING"
SPINE = "book STRING, pos INT, idref STRING, spread STRING"
QUEUE = "slug STRING, title STRING, authors STRING, pdf_path STRING"
EVENTS = "event STRING, seq BIGINT, payload STRING"
