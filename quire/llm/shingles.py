"""Near copies among documents: SimHash and BK-trees find them at any radius, whole shingle sets confirm them.

Fingerprints that may differ in a third of their bits agree in no block of useful width, so shards are cut by least
hashes instead: texts whose Jaccard similarity is at least 0.8 share one of BANDS shards with a likelihood of
1 - (1 - 0.8^ROWS)^BANDS, all but one in 36 000 pairs that are just as similar as that, and of more similar ones fewer
are missed. Each shard grows BK-trees of its members' fingerprints and follows only edges within the radius; what the
trees link is then compared by its whole sets, pair by pair within the shards and the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut, given, join_counted, words_of
from quire.llm.graph import connected_components, link_groups
from quire.llm.simhash import Groups, signed, tree_links

SEED, WIDTH = 42, 5
#: Two texts are near copies if their similarity is at least this fraction.
LEAST = (4, 5)
#: Shards of a text: each is named by so many least hashes.
BANDS, ROWS = 20, 4
#: Fingerprints of sets just as similar as LEAST differ in 9.7 of 64 bits, give or take 2.9: five deviations are within.
RADIUS = 24
#: Whole sets that one task holds at a time are at most about twice as many; more of a group take several steps.
CHUNK = 4096
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, WIDTH + 2 + BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = np.random.default_rng(SEED + 1).integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The 64-bit hashes of a whole text's shingles, distinct and sorted. A-Z are lower-cased; a text of fewer words
    than `width` is one shingle, one without words (or null) has none."""
    words = [w.lower() for w in words_of(text)] if text else []
    if not words:
        return np.empty(0, np.int64)
    hashed = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in words]), ">u8").astype(np.uint64)
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64) * _ODD[WIDTH]
    for i in range(width):
        out += hashed[i : i + n] * _ODD[i]
    out = (out ^ (out >> np.uint64(32))) * _ODD[WIDTH + 1]
    out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def set_id(shingles: np.ndarray) -> int:
    return int(np.frombuffer(xxhash.xxh64_digest(shingles.tobytes(), SEED), np.int64)[0])


def sketch(shingles: np.ndarray) -> tuple[int, list[int]]:
    """The SimHash of a set, unsigned, and the names of its shards; both by blocks, so memory is bounded. The empty set
    has fingerprint 0 and no shards: it is similar to nothing but itself."""
    if not len(shingles):
        return 0, []
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096].view(np.uint64)
        ones += np.add.reduce(np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.int32)
        for i in range(0, len(part), 512):
            np.minimum(least, (part[i : i + 512, None] * _ODD[None, WIDTH + 2 :] + _PLUS).min(0), out=least)
    bands = least.reshape(BANDS, ROWS)
    names = [int.from_bytes(xxhash.xxh64_digest(b.tobytes(), k), "big", signed=True) for k, b in enumerate(bands)]
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big"), names


def similar(na, nb, common, least: tuple[int, int]):
    """Whether sets of these sizes with so many common members are at least as similar as `least`."""
    return common * (least[0] + least[1]) >= least[0] * (na + nb)


def linked_sets(tile: list[tuple], least: tuple[int, int], radius: int) -> Iterator[tuple[int, int]]:
    """Edges between sets (name, root or None, fingerprint, shards, members) that connect them as all links between them
    do. Compared are sets of one shard whose fingerprints are within the radius, as the trees compare them, unless they
    are connected already."""
    groups, first, mask = Groups(), {}, (1 << 64) - 1
    sets: list[np.ndarray] = []
    prints: list[int] = []
    shards: dict[int, dict[int, list[int]]] = {}  # the members of each shard, by their group

    def linked(n: int, k: int) -> bool:
        a, b = sets[n], sets[k]
        return (prints[n] ^ prints[k]).bit_count() <= radius and similar(len(a), len(b), min(len(a), len(b)), least) and bool(similar(len(a), len(b), len(np.intersect1d(a, b, True)), least))

    for uid, root, fp, bands, s in tile:
        n = groups.add()
        sets.append(np.array(s, np.int64))
        prints.append(fp & mask)
        if root is not None:
            groups.join(first.setdefault(root, n), n)
        met: set[int] = set()
        for band in bands:
            shard = shards.get(band, {})
            for g in [g for g in shard if groups.find(g) != g]:
                shard.setdefault(groups.find(g), []).extend(shard.pop(g))
            for g, members in shard.items():
                if groups.find(g) == groups.find(n):
                    continue
                for k in members:
                    if k not in met and linked(n, k):
                        yield uid, tile[groups.find(k)][0]  # the group's first, so that components settle in few rounds
                        groups.join(k, n)
                        break
                    met.add(k)
        for band in bands:
            shards.setdefault(band, {}).setdefault(groups.find(n), []).append(n)


def candidates(sets: DataFrame, radius: int, least: tuple[int, int], shard_rows: int = 2 * CHUNK) -> DataFrame:
    """(a, b): edges that connect the sets (uid, n, fp, bands) which the shards' trees find near each other. Sets of
    sizes that make `least` impossible are not linked."""

    def fits(x: tuple, y: tuple) -> bool:
        return similar(x[3], y[3], min(x[3], y[3]), least)

    shards = sets.select(F.explode("bands").alias("shard"), "uid", "fp", "n")
    return link_groups(shards, "shard", "uid", shard_rows, lambda tile: tree_links(tile, radius, fits))


def near_copy_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, t (hash of the text), uid (its shingle set) and root (its group).

    Texts are linked if their sets of `width`-word shingles have a Jaccard similarity of at least `least`; groups are
    what links connect. Texts without words are linked to each other only. Null ids and repeated rows are rows like
    any other; an empty table gives none; other columns are not read.

    Texts are read twice and only sets that a tree has linked are sent whole: each to the tasks that compare its part
    of a connected component, `chunk` sets with as many others at a time, so no component meets in one task.
    """

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        for i, t, h in it:
            s = shingle_set(t, width)
            fp, bands = sketch(s)
            yield i, h, set_id(s), len(s), signed(fp), bands

    body = F.col(text).cast("string")
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("t"))
    kinds = [("doc_id", pa.int64()), ("t", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))]
    sets = cut(arrow_map(ids, rows, "doc_id long, t long, uid long, n long, fp long, bands array<long>", pa.schema(kinds), 64))
    once = sets.groupBy("uid").agg(F.min("t").alias("t"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    once = cut(once.where("n > 0"))
    parts = connected_components(candidates(once, radius, least, 2 * chunk), "a", "b").withColumnRenamed("node", "uid")
    placed = cut(parts.join(once.select("uid", "t", "fp", "bands"), "uid"))

    def whole(it: Iterator[tuple]) -> Iterator[tuple]:
        for t, h in it:
            s = shingle_set(t, width)
            yield set_id(s), h, s

    # Copies of a text are one set: of the rows with its hash, those of one text hash are enough.
    bodies = given(ids, placed.select("t").distinct(), ["t"]).select("text", "t")
    found = arrow_map(bodies, whole, "uid long, t long, s array<long>", pa.schema([("uid", pa.int64()), ("t", pa.int64()), ("s", pa.list_(pa.int64()))]), 64)
    found = found.dropDuplicates(["uid"]).drop("t")
    told = cut(found.join(placed.drop("t"), "uid").select(F.col("root").alias("part"), "uid", "fp", "bands", "s"))
    edges = link_groups(told, "part", "uid", chunk, lambda tile: linked_sets(tile, least, radius))
    roots = connected_components(edges, "a", "b").withColumnRenamed("node", "uid")
    named = sets.select("doc_id", "t", "uid").join(roots, "uid", "left")
    return named.select("doc_id", "t", "uid", F.coalesce("root", "uid").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near copies, all columns as they were: the one of the least doc_id, rows
    without one last; of rows that repeat it with another text of the group, any one.

    Only the rows that go, and those that a kept row repeats, are named to the texts; where they are few enough that
    is a broadcast, so texts stay where they are.
    """
    groups = cut(near_copy_groups(docs, doc_id, text, **options))
    key = ["last", "id", "t"]
    who = (F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("t"))
    least = cut(groups.groupBy("root").agg(F.min(F.struct(*who)).alias("w"), F.count("*").alias("n")))
    told = join_counted(groups.select("root", *who), least, ["root"]).withColumn("kept", F.struct(*key) == F.col("w"))
    odd = cut(told.groupBy(*key).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1").drop("n"))
    i = F.col(doc_id).cast("long")
    rows = docs.select(F.struct("*").alias("row"), i.isNull().alias("last"), F.coalesce(i, F.lit(0)).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("t"))
    single = given(rows, odd.select(*key), key, "left_anti")
    repeated = given(rows, odd.where("kept").select(*key), key).dropDuplicates(key)
    return single.select("row.*").union(repeated.select("row.*"))
