"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision only where they leave doubt."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.common import cut, join_counted, remove_dir, shared_dir, small_batches
from quire.llm.graph import connected_components

TILE = 1024
#: Above the rounding of the products in double precision.
SLACK = 1e-9
#: Above the rounding of angles: an arc cosine near 1 has half the digits.
ANGLE_SLACK = 1e-6
CODE_BITS = 24
PAIRS_PER_TASK = 8


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length -> (int8 codes, scale, length of what the codes miss) for each row."""
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b (unit length, double) have a cosine of at least threshold.

    With x = x' + e and y = y' + f, |x.y - x'.y'| <= |e||y| + |x'||f| <= e + (1 + e) f. The int8 product decides all
    pairs whose distance from the threshold is above that bound; the others are computed again in full precision.
    """
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    # Sums of int8 products of up to 1040 components are whole numbers below 2^24, which float32 holds exactly.
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * (sa[:, None] * sb)
    bound = ea[:, None] + (1 + ea)[:, None] * eb + SLACK
    links = near >= threshold + bound
    i, j = np.nonzero((near >= threshold - bound) & ~links)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        links[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return links


def lowest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id in the component of each row and each column of one tile pair."""
    a, b, top = a.copy(), b.copy(), np.iinfo(np.int64).max
    while True:
        low = np.minimum(b, np.where(links, a[:, None], top).min(0, initial=top))
        new = np.minimum(a, np.where(links, low, top).min(1, initial=top))
        if (new == a).all() and (low == b).all():
            return a, b
        a, b = new, low


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tile:
    """Distinct vectors of one label: names, copies and unit vectors, their centre and the widest angle from it."""

    ids: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray
    radius: float

    @classmethod
    def of(cls, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> Tile:
        vectors = unit(vectors)
        centre = vectors.sum(0)
        size = np.linalg.norm(centre)
        centre = centre / size if size > 1e-6 else vectors[0]
        return cls(ids, copies, vectors, centre, float(angles(vectors, centre).max()))

    def within(self, other: Tile, threshold: float) -> Tile:
        """The vectors that may link with one of the other tile's, by the triangle inequality of angles."""
        near = angles(self.vectors, other.centre) <= other.radius + math.acos(threshold) + ANGLE_SLACK
        return Tile(self.ids[near], self.copies[near], self.vectors[near], self.centre, self.radius)


def angles(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centre, -1, 1))


def compare(a: Tile, b: Tile | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pair of tiles, or one with itself (b is None) -> (ids, links of each, smallest id of its component), for those
    with a link."""
    if b is None:
        links = tile_links(a.vectors, a.vectors, threshold)
        links |= links.T
        np.fill_diagonal(links, False)
        total, some = links @ a.copies, links.any(1)
        roots = a.ids.copy()
        sub = links[np.ix_(some, some)]
        np.fill_diagonal(sub, True)
        roots[some] = np.minimum(*lowest(sub, a.ids[some], a.ids[some]))
        keep = total > 0
        return a.ids[keep], total[keep], roots[keep]
    a, b = a.within(b, threshold), b.within(a, threshold)
    if not len(a.ids) or not len(b.ids):
        return a.ids[:0], a.copies[:0], a.ids[:0]
    links = tile_links(a.vectors, b.vectors, threshold)
    rows, cols = links.any(1), links.any(0)
    low_a, low_b = lowest(links[np.ix_(rows, cols)], a.ids[rows], b.ids[cols])
    counts = (links @ b.copies)[rows], (links.T @ a.copies)[cols]
    return np.concatenate([a.ids[rows], b.ids[cols]]), np.concatenate(counts), np.concatenate([low_a, low_b])


def comparable(label: Column, vector: Column) -> Column:
    """Whether a row can link: a label, and a vector with finite components that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def direction(vectors: np.ndarray) -> np.ndarray:
    """Numbers by which near vectors come near each other in order: the signs of CODE_BITS fixed random projections."""
    planes = np.random.default_rng(vectors.shape[1]).normal(size=(vectors.shape[1], CODE_BITS))
    return ((vectors @ planes) > 0) @ (np.int64(1) << np.arange(CODE_BITS, dtype=np.int64)[::-1])


def coded(classes: DataFrame) -> DataFrame:
    """classes with a column `code`, the direction() of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
            code = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                code[at] = direction(matrix(batch.take(pa.array(at)), int(dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    return small_batches(classes).mapInArrow(run, StructType([*classes.schema.fields]).add("code", "long"))


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)


def write_tiles(classes: DataFrame, out: str, tile: int) -> DataFrame:
    """Writes classes (class_id, label, dim, copies, vector) as tiles of up to `tile` vectors of one label, near ones
    together, and returns their stored manifest: label, dim, path, at (the tile's place in the file), name, centre, radius.

    Each task writes what a range of the order holds, so no label is one task; only files of tasks that succeeded are
    in the manifest.
    """
    order = ["label", "dim", "code", "class_id"]
    dealt = coded(classes.select("label", "dim", "class_id", "copies", "vector")).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ("label", "dim", "path", "at", "name", "centre", "radius")
    arrow = pa.schema([("label", pa.int64()), ("dim", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())])
    stored_as = pa.schema([("class_id", pa.int64()), ("copies", pa.int64()), ("vector", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)
        held: list[pa.RecordBatch] = []
        current, n, told = None, 0, []
        path, file, writer = f"tiles-{uuid.uuid4().hex}.arrow", None, None

        def flush() -> None:
            nonlocal held, n, file, writer
            if not n:
                return
            if file is None:
                store.create_dir(folder, recursive=True)
                file = store.open_output_stream(f"{folder}/{path}")
                writer = pa.ipc.new_file(file, stored_as)
            whole = pa.Table.from_batches(held).select(["class_id", "copies", "vector"]).cast(stored_as).combine_chunks()
            made = Tile.of(whole["class_id"].to_numpy(), whole["copies"].to_numpy(), matrix(whole.to_batches()[0], current[1]))
            writer.write_batch(whole.to_batches()[0])
            told.append((*current, path, len(told), f"{path}#{len(told):09d}", made.centre.tolist(), made.radius))
            held, n = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("label", "dim")]
            change = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])) + 1
            for lo, hi in zip([0, *change], [*change, batch.num_rows]):
                this = int(key[0][lo]), int(key[1][lo])
                if this != current:
                    flush()
                    current = this
                while lo < hi:
                    some = min(hi - lo, tile - n)
                    held.append(batch.slice(lo, some))
                    n, lo = n + some, lo + some
                    if n == tile:
                        flush()
        flush()
        if file is not None:
            writer.close()
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), arrow)], schema=arrow)

    kinds = ("long", "long", "string", "long", "string", "array<double>", "double")
    return cut(dealt.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))))


def linked_classes(tiles: DataFrame, out: str, threshold: float) -> DataFrame:
    """(class_id, links, root) from each pair of tiles in which a class has links.

    A row is a pair of tiles, not their vectors: those are read from the shared folder by the task that compares them,
    so nothing but names is shuffled. Tiles too far apart for any link, by centres and radii, are not paired.
    """
    a = tiles.select("label", "dim", *(F.col(c).alias(f"{c}_a") for c in ("path", "at", "name", "centre", "radius")))
    b = tiles.select("label", "dim", *(F.col(c).alias(f"{c}_b") for c in ("path", "at", "name", "centre", "radius")))
    apart = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.acos(F.least(F.greatest(apart, F.lit(-1.0)), F.lit(1.0)))
    near = (F.col("name_a") == F.col("name_b")) | (apart <= F.col("radius_a") + F.col("radius_b") + math.acos(threshold) + ANGLE_SLACK)
    pairs = cut(a.join(b, ["label", "dim"]).where(F.col("name_a") <= F.col("name_b")).where(near).select("dim", "path_a", "at_a", "path_b", "at_b"))
    arrow = pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)

        def read(path: str, at: int, dim: int) -> Tile:
            with store.open_input_file(f"{folder}/{path}") as f:
                part = pa.ipc.open_file(f).get_batch(at)
                return Tile.of(part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part, dim))

        held: dict[tuple, Tile] = {}
        for batch in batches:
            for dim, *names in zip(*(c.to_pylist() for c in batch.columns)):
                first, second = tuple(names[:2]), tuple(names[2:])
                held = {k: t for k, t in held.items() if k in (first, second)}
                for k in (first, second):
                    if k not in held:
                        held[k] = read(*k, dim)
                found = compare(held[first], held[second] if second != first else None, threshold)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], schema=arrow)

    # A number of tasks of its own: the rows are few bytes each, so Spark would take them all for one task's work.
    tasks = max(1, -(-pairs.count() // PAIRS_PER_TASK))
    spread = pairs.repartition(tasks, "path_a", "at_a", "path_b", "at_b").sortWithinPartitions("path_a", "at_a")
    return spread.mapInArrow(run, "class_id long, links long, root long")


def embedding_groups(rows: DataFrame, threshold: float = 0.93, tile: int = TILE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of rows: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and their cosine is at least threshold. Rows whose label is null, or whose
    vector is null, empty, zero or holds a null or non-finite component, link with nothing; nor do vectors of unequal
    lengths. Equal vectors of a label are one class, compared once and counted as often as they occur: a row
    repeated under one id counts as another vector. A null vec_id links like any other but is never the name of a
    component, unless no member has an id. An empty table gives no rows. Other columns are not read.
    """
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("vector"))
    v = v.withColumn("ok", comparable(F.col("label"), F.col("vector")))
    able = v.where("ok").select("vec_id", "label", F.size("vector").cast("long").alias("dim"), "vector")
    group = ["label", "dim", "vector"]
    classes = cut(able.groupBy(*group).agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")).withColumn("class_id", F.monotonically_increasing_id()))
    out = f"{shared_dir(rows.sparkSession).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    try:
        found = cut(linked_classes(write_tiles(classes, out, tile), out, threshold))
    finally:
        remove_dir(out)
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    roots = cut(connected_components(found.select("class_id", "root").distinct(), "class_id", "root").withColumnRenamed("node", "class_id"))
    names = cut(roots.join(classes.select("class_id", "first_id"), "class_id").groupBy("root").agg(F.min("first_id").alias("name"), F.count("*").alias("n")))
    named = join_counted(roots, names, ["root"]).select("class_id", "name")
    told = cut(classes.join(links, "class_id", "left").join(named, "class_id", "left").select(*group, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "first_id").alias("component_id"), F.col("copies").alias("n")))
    linked = join_counted(able, told, group, size=8 * F.col("dim")).select("vec_id", "n_links", "component_id")
    alone = v.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
