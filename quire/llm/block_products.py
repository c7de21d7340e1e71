"""Hard-negative mining by block products: integer score tiles are sums of partial products over chunks of dimensions.

Rows and anchors are cut into blocks and these by dimensions into chunks. A task multiplies a chunk of an anchor block
by the same chunk of a block of rows; the partial tiles of a pair of blocks are shuffled to one task, which adds them up
and keeps the best of each anchor's windows. A first pass meets only blocks that may share labels and finds the
positives, a second one finds the negatives between the bounds that these set.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, remove_dir, shared_dir, small_batches

#: Rows of a block, anchors of a block, and dimensions of a chunk: a tile is 2 MB.
ROWS, ANCHORS, CHUNK = 1024, 256, 32
#: Partial tiles that one task makes.
TILES_PER_TASK = 64
#: Blocks of anchors that a task holds at a time.
HELD = 64
#: Candidates that a task gathers before it drops all but the best of each window.
PRUNE_AT = 100_000

BLOCKS = pa.schema([("dim", pa.int64()), ("block", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("least", pa.int64()), ("most", pa.int64())])
PART = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("part", pa.list_(pa.int64()))])


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64)).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer product of a and the transpose of b: in double precision where no sum can leave the 53 bits
    that this holds exactly, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def usable(vec_id: Column, label: Column, vector: Column, scale: float) -> Column:
    """Whether a row takes part: an id, a label and a vector of finite components whose product with itself is below
    2^62, so that no product of two rows leaves 64 bits."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0)))
    return F.coalesce(vec_id.isNotNull() & label.isNotNull() & finite & (size < 2.0**62), F.lit(False))


def write_blocks(rows: DataFrame, out: str, most: int, chunk: int, scale: float) -> DataFrame:
    """Writes rows (vec_id, label, dim, vector) as blocks of up to `most` rows of one dim, in order of label and id, and
    returns their stored manifest: dim, block (a name), path, at, least and most label. Batch at + k of the file is the
    block's k-th chunk of dimensions, as whole numbers.

    Rows that repeat another in all of these are left out. Each task writes what a range of the order holds, so no
    label is one task; only files of tasks that succeeded are in the manifest.
    """
    order = ["dim", "label", "vec_id", "vector"]
    dealt = rows.select(*order).repartitionByRange("dim", "label", "vec_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)
        path, file, writer, written = f"blocks-{uuid.uuid4().hex}.arrow", None, None, 0
        last, told = None, []

        def kept() -> Iterator[tuple]:
            nonlocal last
            for b in batches:
                for i in range(0, b.num_rows, most):
                    for r in zip(*(c.to_pylist() for c in b.slice(i, most).columns)):
                        if r != last:
                            yield r
                        last = r

        for dim, run_of in itertools.groupby(kept(), key=lambda r: r[0]):
            for block in itertools.batched(run_of, most):
                if file is None:
                    store.create_dir(folder, recursive=True)
                    file = store.open_output_stream(f"{folder}/{path}")
                    writer = pa.ipc.new_file(file, PART)
                labels, ids = [r[1] for r in block], [r[2] for r in block]
                whole = integers(np.array([r[3] for r in block], np.float64).reshape(len(block), dim), scale)
                for k in range(max(1, -(-dim // chunk))):
                    part = whole[:, k * chunk : (k + 1) * chunk]
                    offsets = pa.array(np.arange(len(block) + 1, dtype=np.int32) * part.shape[1])
                    writer.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], schema=PART))
                told.append((dim, f"{path}#{written:09d}", path, written, min(labels), max(labels)))
                written += max(1, -(-dim // chunk))
        if file is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), BLOCKS)], schema=BLOCKS)

    return cut(small_batches(dealt).mapInArrow(run, "dim long, block string, path string, at long, least long, most long"))


@dataclass
class Shelf:
    """Blocks read from the shared folder; the last HELD of them are held."""

    out: str

    def __post_init__(self) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(self.out)
        self.held: dict[tuple, tuple] = {}

    def get(self, path: str, at: int, names: bool = False) -> tuple[np.ndarray, ...]:
        """(ids, labels) of a block, or the (numbers,) of one of its chunks."""
        key = (path, at, names)
        if key not in self.held:
            if len(self.held) >= HELD:
                del self.held[next(iter(self.held))]
            with self.store.open_input_file(f"{self.folder}/{path}") as f:
                options = pa.ipc.IpcReadOptions(included_fields=[0, 1] if names else [2])
                b = pa.ipc.open_file(f, options=options).get_batch(at)
                if names:
                    self.held[key] = b.column(0).to_numpy().copy(), b.column(1).to_numpy().copy()
                else:
                    self.held[key] = (b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).copy() if b.num_rows else np.zeros((0, 0), np.int64),)
        return self.held[key]


WINDOWS = pa.list_(pa.struct([(n, pa.int64()) for n in ("place", "positive", "positive_id", "positive_score")]))
WINDOWS_AS = "array<struct<place: long, positive: long, positive_id: long, positive_score: long>>"
NAMES = ("anchors", "rows", "path_a", "at_a", "path_r", "at_r")
TILE = pa.schema([("anchors", pa.string()), ("rows", pa.string()), ("path_a", pa.string()), ("at_a", pa.int64()), ("path_r", pa.string()), ("at_r", pa.int64()), ("windows", WINDOWS), ("tile", pa.binary())])
TILE_AS = f"anchors string, rows string, path_a string, at_a long, path_r string, at_r long, windows {WINDOWS_AS}, tile binary"


def block_pairs(anchors: DataFrame, rows: DataFrame, same_label: bool) -> DataFrame:
    """Names of all pairs of an anchor block and a block of rows of one dim, or of those that may share a label, with
    the anchor block's windows. Names are dealt in as many shares as there are anchor blocks, so that no key is hot."""
    shares = max(1, anchors.count())
    a = anchors.select("dim", F.col("block").alias("anchors"), F.col("path").alias("path_a"), F.col("at").alias("at_a"), F.col("least").alias("least_a"), F.col("most").alias("most_a"), "windows", F.pmod(F.xxhash64("block"), F.lit(shares)).alias("share"))
    r = rows.select("dim", F.col("block").alias("rows"), F.col("path").alias("path_r"), F.col("at").alias("at_r"), "least", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
    met = r.join(a, ["dim", "share"])
    return (met.where("least_a <= most and least <= most_a") if same_label else met).select("dim", *NAMES, "windows")


def partial_tiles(pairs: DataFrame, out: str, chunk: int) -> DataFrame:
    """The partial tiles of block pairs, one for each chunk of dimensions: 64-bit integers, row after row. The first
    one of a pair has its windows with it."""
    chunks = F.greatest(F.ceil(F.col("dim") / chunk), F.lit(1)).cast("int")
    parts = pairs.select(*NAMES, "windows", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("k"))
    parts = parts.select(*NAMES, F.when(F.col("k") == 0, F.col("windows")).alias("windows"), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(out)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                path_a, at_a, path_r, at_r, k = (row.column(row.schema.get_field_index(c))[0].as_py() for c in ("path_a", "at_a", "path_r", "at_r", "k"))
                tile = product(shelf.get(path_a, at_a + k)[0], shelf.get(path_r, at_r + k)[0])
                yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([tile.tobytes()], pa.binary())], names=TILE.names)

    # A number of tasks of its own: the rows are few bytes each, so Spark would take them all for one task's work.
    tasks = max(1, -(-parts.count() // TILES_PER_TASK))
    spread = parts.repartition(tasks, "rows", "k").sortWithinPartitions("rows", "k")
    return small_batches(spread).mapInArrow(run, TILE_AS)


@dataclass
class Best:
    """The `most` best candidates so far of each window, as columns: window, id, score, and what else is told of it."""

    most: int

    def __post_init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append([*columns])
        self.n += len(columns[0])
        if self.n > PRUNE_AT:
            self.parts = [self.best()]
            self.n = 0

    def best(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        window, ids, scores = columns[:3]
        order = np.lexsort((ids, -scores, window))
        window = window[order]
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        place = np.arange(len(window)) - np.repeat(starts, np.diff(np.append(starts, len(window))))
        return [c[order][place < self.most] for c in columns]


def first_of(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Those of the places `at` that have the `most` highest scores, ties by the smaller id."""
    if len(at) <= most:
        return at
    at = at[scores[at] >= np.partition(scores[at], -most)[-most]]
    return at[np.lexsort((ids[at], -scores[at]))[:most]]


FOUND = pa.schema([("anchors", pa.string()), *((n, pa.int64()) for n in ("place", "anchor_id", "positive", "positive_id", "positive_score", "found_id", "score"))])
FOUND_AS = "anchors string, place long, anchor_id long, positive long, positive_id long, positive_score long, found_id long, score long"


def best_of_tiles(tiles: DataFrame, out: str, most: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Adds up the partial tiles of each pair of blocks and tells the `most` best rows of each anchor's label, or with
    low and high those of other labels in each of the anchor's windows. A task tells what is best in all of its tiles."""
    dealt = tiles.repartition("anchors", "rows").sortWithinPartitions("anchors", "rows")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(anchors, place of both blocks, windows, tile) of each pair; one tile and one part are held at a time."""
        current, place, windows, tile = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                name = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                part = np.frombuffer(row.column(7)[0].as_buffer(), np.int64)
                if name != current:
                    if current:
                        yield current[0], place, windows, tile
                    current, place, windows, tile = name, [row.column(c)[0].as_py() for c in range(2, 6)], None, part.copy()
                else:
                    tile += part
                windows = row.column(6)[0].as_py() or windows
        if current:
            yield current[0], place, windows, tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(out)
        for anchors, group in itertools.groupby(summed(batches), key=lambda x: x[0]):
            best = Best(most)
            for _, (path_a, at_a, path_r, at_r), windows, tile in group:
                (ids_a, labels_a), (ids, labels) = shelf.get(path_a, at_a, True), shelf.get(path_r, at_r, True)
                scores = tile.reshape(len(ids_a), len(ids))
                other = ids_a[:, None] != ids
                same = labels_a[:, None] == labels
                if low is None:
                    asked = [(p, 0, 0, 0, None, None) for p in range(len(ids_a))]
                else:  # whole numbers: low * p <= 100 * s <= high * p
                    asked = [(w["place"], w["positive"], w["positive_id"], p, -(-low * p // 100), high * p // 100) for w in windows or () for p in (w["positive_score"],)]
                for p, positive, positive_id, positive_score, least, greatest in asked:
                    fits = other[p] & same[p] if least is None else other[p] & ~same[p] & (scores[p] >= least) & (scores[p] <= greatest)
                    at = first_of(np.flatnonzero(fits), ids, scores[p], most)
                    if len(at):
                        told = [np.full(len(at), x, np.int64) for x in (p, ids_a[p], positive, positive_id, positive_score)]
                        best.add(told[0] << 32 | told[2], ids[at], scores[p][at], *told)
            if best.parts:
                _, ids, scores, *told = best.best()
                yield pa.RecordBatch.from_arrays([pa.array([anchors] * len(ids)), *(pa.array(c) for c in told), pa.array(ids), pa.array(scores)], schema=FOUND)

    return small_batches(dealt).mapInArrow(run, FOUND_AS)


def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` first of what all tasks told of each window, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", blocks: tuple[int, int] = (ROWS, ANCHORS), chunk: int = CHUNK) -> DataFrame:
    """One row for each anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    Components become floor(scale * x); a row's score is its integer inner product with the anchor. Higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first `positives` rows of the same label; each one's
    negatives are the first `negatives` rows of other labels whose score is between `low` and `high` hundredths of the
    positive's. rows whose vec_id, label or vector is null, or whose vector holds null or non-finite components, take
    no part, nor do such whose product with themselves is above 2^62; vectors of other lengths than the anchor's don't
    meet it. Rows that repeat id, label and vector are one row; rows that share just an id are rows of their own, but
    never each other's positives or negatives. ids and labels are whole numbers. Zero and empty vectors score 0. An
    empty table, or one without anchors, gives no rows. is_anchor is a condition on rows; other columns are not read.

    Vectors are written to the shared folder once, as blocks; names and tiles are what is shuffled.
    """
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.size(embedding).cast("long").alias("dim"), F.col(embedding).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    able = named.where(usable(F.col("vec_id"), F.col("label"), F.col("vector"), scale))
    out = f"{shared_dir(rows.sparkSession).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    try:
        all_rows = write_blocks(able, out, blocks[0], chunk, scale)
        anchors = write_blocks(able.where("is_anchor"), out, blocks[1], chunk, scale)
        near = block_pairs(anchors.withColumn("windows", F.lit(None).cast(WINDOWS_AS)), all_rows, True)
        key = ["anchors", "place"]
        firsts = ranked(best_of_tiles(partial_tiles(near, out, chunk), out, positives), key, positives)
        window = F.struct("place", F.col("rank").cast("long").alias("positive"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
        # At most `positives` for each anchor of a block.
        windows = firsts.where("score >= 0").groupBy(F.col("anchors").alias("block")).agg(F.collect_list(window).alias("windows"))
        asked = cut(anchors.join(windows, "block"))
        found = best_of_tiles(partial_tiles(block_pairs(asked, all_rows, False), out, chunk), out, negatives, low, high)
        done = cut(ranked(found, [*key, "positive"], negatives))
    finally:
        remove_dir(out)
    return done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


MINE_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM q a JOIN q r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE label = anchor_label)
  WHERE k <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
   AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
