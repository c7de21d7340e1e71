"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items scans each text once,
and what it finds is mapped back to the original text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import AT_ONCE, ascii_lower, cut, remove_dir, running_sums, shared_dir, small_batches

WINDOW = 10
#: A word: a run of characters that are no ASCII blanks, controls or marks, once A-Z are lower-cased.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of windows, item names included, that one automaton is made of.
PART_BYTES = 2 << 20
#: Bytes of text that are scanned with one automaton before the next is made, where a benchmark needs several.
GROUP_BYTES = 32 << 20
#: What becomes of the bytes of UTF-8: A-Z are lower-cased, what is in no word is a space, all others stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(words, item): the distinct windows of each field of each item, words joined and enclosed by spaces."""
    named = benchmark.select(F.col(item_id).cast("string").alias("item"), F.explode(F.array(*(F.col(c).cast("string") for c in fields))).alias("text"))
    words = named.select("item", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(ITEM_WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = words.select("item", "w", F.explode(starts).alias("at"))
    joined = F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("at"), window), " "), F.lit(" "))
    return each.select(joined.alias("words"), "item").distinct()


def write_parts(windows: DataFrame, part_bytes: int = PART_BYTES) -> tuple[str, int]:
    """The windows as Parquet in a new folder of the shared one, in parts of about part_bytes each however many items
    share a window: the folder, in which part k is `part=k`, and the number of parts. They don't pass through the
    driver."""
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    placed = running_sums(windows, [F.col("words"), F.col("item")], {"upto": size})
    parts = placed.withColumn("part", F.floor(F.col("upto") / part_bytes).cast("int"))
    path = f"{shared_dir(windows.sparkSession).rstrip('/')}/windows-{uuid.uuid4().hex}"
    try:
        parts.repartition("part").write.partitionBy("part").parquet(path)
        last = windows.sparkSession.read.schema("words string, item string, part int").parquet(path).agg(F.max("part")).first()[0]
    except Exception:
        remove_dir(path)
        raise
    return path, 0 if last is None else last + 1


@dataclass
class Scanner:
    """An automaton whose values are (words of the window, items that have it)."""

    automaton: ahocorasick.Automaton

    @classmethod
    def of(cls, windows: Iterator[tuple[str, str | None]]) -> Scanner:
        items: dict[str, list[str]] = {}
        for words, item in windows:
            items.setdefault(words, []).extend([item] if item is not None else [])
        automaton = ahocorasick.Automaton()
        for words, held in items.items():  # bytes of UTF-8 as characters, so that offsets are those of bytes
            automaton.add_word(words.encode("utf-8", "surrogatepass").decode("latin-1"), (words.count(" ") - 1, held))
        automaton.make_automaton()
        return cls(automaton)


@lru_cache(maxsize=1)
def scanner(path: str, part: int) -> Scanner:
    """The automaton of a part. A Python worker holds one at a time; tasks that follow one another in it share that."""
    store, folder = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(f"{folder}/part={part}"))

    def rows() -> Iterator[tuple[str, str | None]]:
        for f in files:
            if f.base_name.endswith(".parquet"):
                with store.open_input_file(f.path) as opened:
                    held = pq.ParquetFile(opened).read(columns=["words", "item"])
                    yield from zip(held["words"].to_pylist(), held["item"].to_pylist())

    return Scanner.of(rows())


@dataclass
class Scanned:
    """A text in bytes, and what was found so far: (first hit word, word behind the last) of each hit, and items."""

    raw: bytes
    n_words: int = 0
    hits: list[np.ndarray] = field(default_factory=list)
    items: set[str] = field(default_factory=set)

    def scan(self, by: Scanner) -> None:
        words = self.raw.translate(NORMAL).split()
        self.n_words = len(words)
        if not words:
            return
        found = list(by.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if found:
            behind = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # the space behind each word
            last = np.searchsorted(behind, np.array([at for at, _ in found]))
            self.hits.append(np.unique(np.column_stack([last - np.array([n for _, (n, _) in found]) + 1, last + 1]), axis=0))
            self.items.update(i for _, (_, held) in found for i in held)

    def hit_words(self) -> np.ndarray:
        """Whether each word is hit."""
        steps = np.zeros(self.n_words + 1, np.int64)
        for h in self.hits:
            np.add.at(steps, h[:, 0], 1)
            np.add.at(steps, h[:, 1], -1)
        return steps[:-1].cumsum() > 0

    def told(self) -> tuple[int, int, list[dict], list[str]]:
        """(words, hit words, stretches of hit words as code points of the original text, items)."""
        if not self.hits:
            return self.n_words, 0, [], []
        raw = np.frombuffer(self.raw, np.uint8)
        in_word = np.frombuffer(self.raw.translate(NORMAL), np.uint8) != 32
        edge = np.diff(np.concatenate([[False], in_word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hit = self.hit_words()
        turn = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
        points = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before each byte
        spans = [{"start": int(points[a]), "end": int(points[b])} for a, b in zip(starts[first], ends[last])]
        return self.n_words, int(hit.sum()), spans, sorted(self.items)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SPANS_AS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", fields: tuple[str, ...] = ("text",), part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words within an occurrence of a window), spans (stretches of hit
    words, as offsets in code points of the whole original text) and items (names of the items met, sorted).

    A window is `window` words in a row of one of an item's `fields`; a field of fewer words is one window, one without
    words (or null) has none. Null texts have no words. Rows that repeat an item_id are one item; one without an
    item_id hits words, but is not named. Repeated documents are each told; a null doc_id is a row like any other. No
    benchmark hits nothing; no documents give no rows. Other columns are not read.

    Texts stay where they are and are read once. The benchmark is cut into parts of bounded size, each of which is one
    automaton in the tasks that scan; a benchmark of one part (some 100 000 words) needs one scan of each text.
    """
    path, n_parts = write_parts(item_windows(benchmark, window, item_id, fields), part_bytes)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(rows.schema.fields[:1]).add("n_words", "long").add("n_hit", "long").add("spans", SPANS_AS).add("items", T.ArrayType(T.StringType()))

    def scanned(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [Scanned((t or "").encode("utf-8", "surrogatepass")) for b in held for t in b.column(1).to_pylist()]
        for k in range(n_parts):
            by = scanner(path, k)
            for t in texts:
                t.scan(by)
        for t in texts if not n_parts else ():
            t.n_words = len(t.raw.translate(NORMAL).split())
        told, at = [t.told() for t in texts], 0
        for b in held:
            cols = list(zip(*told[at : at + b.num_rows]))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], SPANS), pa.array(cols[3], pa.list_(pa.string()))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for i in range(0, whole.num_rows, AT_ONCE):
                held.append(whole.slice(i, AT_ONCE))
                size += held[-1].nbytes
                if n_parts < 2 or size >= GROUP_BYTES:
                    yield from scanned(held)
                    held, size = [], 0
        if held:
            yield from scanned(held)

    try:
        return cut(small_batches(rows).mapInArrow(run, schema))
    finally:
        remove_dir(path)


def digests(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """contamination() with the number of items and the SHA-256 of their names, comma-joined, in their stead."""
    told = contamination(docs, benchmark, **options)
    names = F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256)
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ITEM_WORD}')"
DIGEST_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
