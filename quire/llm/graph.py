"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: link() of link_groups(): the members of one tile, as (member, root or None if unknown, *others) -> edges between
#: members that connect them as all links between different roots do.
Link = Callable[[list[tuple]], Iterator[tuple[int, int]]]


#: Edges that one task takes of an edge table; a table of fewer is one partition and is never shuffled.
EDGES_PER_TASK = 100_000


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node reachable.

    Edges with a null end and self-loops name no component; repeated edges count once; no edges, no rows. Every round
    is two min-aggregations with map-side combine and two joins in which only the edge side can be skewed, written to
    the shared folder, so lineage stays short. Nothing but row counts reaches the driver. Tables have as many
    partitions as EDGES_PER_TASK makes of them at most, for rounds leave ever fewer edges.
    """
    e = cut(edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        shares = max(1, -(-e.count() // EDGES_PER_TASK))
        few = lambda df: df.coalesce(shares)  # noqa: B023, E731
        e = few(e)
        many = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(1))
        deep = e.select("v").join(e.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1))
        if many.isEmpty() and deep.isEmpty():
            node = F.explode(F.array("u", "v")).alias("node")  # roots as often as they have members
            return e.select(node, F.col("v").alias("root")).distinct()
        # The least neighbours are held before they are joined, so that a hub's edges can be split in the join. What is
        # held is made anew if an executor is lost; the round's end is stored.
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))).persist()
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()).persist()
        low = few(large.groupBy("u").agg(F.min("v").alias("m"))).persist()
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        e = cut(few(few(small).distinct()))
        for held in (least, large, low):
            held.unpersist()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def link_tiles(rows: DataFrame, keys: list[str], member: str, link: Link) -> DataFrame:
    """Edges (a, b) that link() finds in every tile: rows of equal keys, which one task has at a time."""
    others = [c for c in rows.columns if c not in (*keys, member, "root")]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, member).select(*keys, member, "root", *others)

    def run(it: Iterator[tuple]) -> Iterator[tuple]:
        for _, tile in itertools.groupby(it, key=lambda r: r[: len(keys)]):
            held = [r[len(keys) :] for r in tile]
            if len(held) > 1:
                yield from link(held)

    return arrow_map(dealt, run, "a long, b long", EDGES, 256)


def link_groups(rows: DataFrame, key: str, member: str, most: int, link: Link) -> DataFrame:
    """Edges (a, b), stored, that connect the members of each key exactly as all links between them do.

    rows: key, member (a long, once for each key) and what link() wants (no column `root`, none that ends in _); read
    several times, so cheap to make or stored. Keys of up to `most` members are a tile
    each. A larger key is cut into tiles; then one member of each component found so far, its leader, meets the others'
    leaders, in tiles again, until that connects little more. Copies of one text are one component by then. What is
    left are pairs of members of different components: these meet in tiles of about `most` with `most`, and parts of
    one component never meet again, so a key costs no more than its components' sizes with each other's.
    """
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), member), F.col(n)).cast("int")
    parts = lambda c: F.greatest(F.ceil(c / most), F.lit(1)).cast("int")
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key, parts(F.col("n_")).alias("tiles_")).persist()
    dealt = rows.join(sizes, key).withColumn("tile_", own("tiles_", 0)).withColumn("root", F.lit(None).cast("long"))
    if sizes.where("tiles_ > 1").isEmpty():
        edges = cut(link_tiles(dealt.drop("tiles_"), [key, "tile_"], member, link))
        sizes.unpersist()
        return edges
    whole = cut(link_tiles(dealt.where("tiles_ = 1").drop("tiles_"), [key, "tile_"], member, link))
    edges = cut(link_tiles(dealt.where("tiles_ > 1").drop("tiles_"), [key, "tile_"], member, link))
    members = cut(rows.join(sizes.where("tiles_ > 1").select(key), key))
    sizes.unpersist()

    def rooted(edges: DataFrame) -> DataFrame:
        roots = connected_components(edges, "a", "b").withColumnRenamed("node", member)
        return members.join(roots.select(member, "root"), member, "left").withColumn("root", F.coalesce("root", member))

    was, salt = members.count(), 0
    while True:
        known = cut(rooted(edges))
        leaders = cut(known.groupBy(key, "root").agg(F.min(member).alias(member)))
        n = leaders.count()
        if 10 * n > 9 * was:
            break
        was, salt = n, salt + 1
        met = leaders.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").select(key, parts(F.col("n_")).alias("tiles_"))
        named = leaders.join(met, key).withColumn("tile_", own("tiles_", salt)).select(key, member, "root", "tile_")
        edges = cut(edges.union(link_tiles(known.drop("root").join(named, [key, member]), [key, "tile_"], member, link)))
    # Blocks: parts of one large component, or small components pooled.
    counts = known.groupBy(key, "root").agg(F.count("*").alias("n_"))
    mixed = counts.groupBy(key).agg(F.count("*").alias("roots_"), F.sum(F.when(F.col("n_") < most, F.col("n_"))).alias("pooled_")).where("roots_ > 1")
    counts = cut(counts.join(mixed, key).withColumn("solo_", F.when(F.col("n_") >= most, F.col("root"))))
    pool = F.pmod(F.xxhash64("root"), parts(F.col("pooled_"))).cast("long")
    block = F.when(F.col("solo_").isNotNull(), F.pmod(F.xxhash64(member), parts(F.col("n_"))).cast("long")).otherwise(pool)
    name = F.concat_ws("/", F.coalesce(F.col("solo_").cast("string"), F.lit("pool")), block)
    blocks = cut(known.join(counts, [key, "root"]).withColumn("block_", name).drop("n_", "roots_", "pooled_"))
    names = blocks.select(key, "block_", "solo_").distinct()
    one, two = names.select(key, F.col("block_").alias("i_"), F.col("solo_").alias("solo_i")), names.select(key, F.col("block_").alias("j_"), F.col("solo_").alias("solo_j"))
    pairs = cut(one.join(two, key).where("i_ <= j_").where(~F.coalesce(F.col("solo_i") == F.col("solo_j"), F.lit(False))).select(key, "i_", "j_"))
    here = blocks.drop("solo_")
    left = here.join(pairs.withColumn("block_", F.col("i_")), [key, "block_"])
    right = here.join(pairs.where("i_ < j_").withColumn("block_", F.col("j_")), [key, "block_"])
    last = link_tiles(left.unionByName(right).drop("block_"), [key, "i_", "j_"], member, link)
    return cut(whole.union(edges).union(last))
