"""SimHash near-duplicates, found with BK-trees over shards of the fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, cut, join_counted, words_of
from quire.llm.graph import connected_components, link_groups

BITS, SEED = 64, 42
#: Blocks of a fingerprint that shards are named by.
BLOCKS = 5
#: One task holds about twice as many fingerprints of a shard at most.
SHARD_ROWS = 8192


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text, unsigned: a bit is 1 if it is set in over half the shingles' hashes.

    A-Z are lower-cased; shingles are `width` words joined by a space and count as often as they occur. A text of
    fewer words is one shingle; one without words (or null) has the fingerprint 0.
    """
    words = [w.lower() for w in words_of(text)] if text else []
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    ones, n = np.zeros(BITS, np.int64), len(words) - width + 1
    digest = xxhash.xxh64_digest
    join = b" ".join
    for at in range(0, n, 1 << 14):
        part = words[at : min(at + (1 << 14), n) + width - 1]
        hashed = b"".join([digest(join(s), SEED) for s in zip(*(itertools.islice(part, i, None) for i in range(width)))])
        bits = np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, BITS)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Groups:
    """Disjoint sets of the numbers 0, 1, ...; a set is named by its smallest."""

    def __init__(self) -> None:
        self.up: list[int] = []

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class BKTree:
    """A tree of 64-bit numbers in which a child hangs on the edge that is its Hamming distance to the parent.

    Nodes hold the members (numbered from 0) that share a value, and whether all members below them are of one group:
    a search for links of a group passes over what is that group's already.
    """

    def __init__(self, groups: Groups) -> None:
        self.groups = groups
        self.values: list[int] = []
        self.members: list[list[int]] = []
        self.children: list[dict[int, int]] = []
        #: A member of the one group that a node and all below it belong to, or -1.
        self.only: list[int] = []
        self.visits = self.visits_then = 0

    def add(self, value: int, member: int) -> None:
        at, find, only = 0, self.groups.find, self.only
        group = find(member)
        while at < len(self.values):
            if only[at] >= 0 and find(only[at]) != group:
                only[at] = -1
            d = (self.values[at] ^ value).bit_count()
            if not d:
                self.members[at].append(member)
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.members.append([member])
        self.children.append({})
        only.append(member)

    def within(self, value: int, radius: int, member: int | None = None) -> Iterator[int]:
        """The members at most `radius` bits from value; those of another group than `member`, if that is given, which
        may join groups meanwhile. By the triangle inequality only edges d-radius..d+radius are followed."""
        if member is not None and self.visits - self.visits_then > 4 * len(self.values):
            self.refresh()
        find, only, values = self.groups.find, self.only, self.values
        stack, own = [0] if values else [], -1 if member is None else find(member)
        while stack:
            at = stack.pop()
            if own >= 0 and only[at] >= 0 and find(only[at]) == own:
                continue
            self.visits += 1
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                for k in self.members[at]:
                    if own < 0 or find(k) != own:
                        yield k
                        own = own if own < 0 else find(member)
            if self.children[at]:
                stack += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]

    def refresh(self) -> None:
        """Finds anew which nodes are of one group, after groups were joined. Children come after their parents."""
        find = self.groups.find
        for at in range(len(self.values) - 1, -1, -1):
            below = [*self.members[at], *(self.only[c] for c in self.children[at].values())]
            group = find(below[0])
            self.only[at] = below[0] if all(k >= 0 and find(k) == group for k in below) else -1
        self.visits_then = self.visits


def tree_links(members: list[tuple], radius: int, fits: Callable[[tuple, tuple], bool] = lambda x, y: True, tree: BKTree | None = None) -> Iterator[tuple[int, int]]:
    """Edges between members (name, root or None, fingerprint, ...) that connect them as all links do: pairs at most
    `radius` bits apart that `fits` admits. Members of one root are connected already.

    There is one tree. A member's search passes over parts of it that are of the member's own group, so a tile of copies
    costs each member a few steps, not one for each pair; parts of other groups are pruned by distances alone.
    Fingerprints are taken as unsigned.
    """
    tree = tree or BKTree(Groups())
    groups, mask, first = tree.groups, (1 << BITS) - 1, {}
    for x in members:
        n, value = groups.add(), x[2] & mask
        if x[1] is not None:
            groups.join(first.setdefault(x[1], n), n)
        for k in tree.within(value, radius, n):
            if fits(x, members[k]):
                yield x[0], members[groups.find(k)][0]  # the group's first, so that components settle in few rounds
                groups.join(k, n)
        tree.add(value, n)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row, repeated rows and null ids or texts included."""

    def rows(it):
        for i, t in it:
            yield i, signed(fingerprint(t, width))

    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(ids, rows, "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


def shard_masks(radius: int, blocks: int) -> list[int]:
    """The bits that name a shard: every choice of all but `radius` of the blocks that 64 bits are cut into. Of two
    fingerprints at most `radius` bits apart one choice agrees whole."""
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    block = [((1 << int(hi)) - 1) ^ ((1 << int(lo)) - 1) for lo, hi in zip(edges, edges[1:])]
    return [signed(sum(chosen)) for chosen in itertools.combinations(block, blocks - radius)]


def fingerprint_links(distinct: DataFrame, radius: int = 2, blocks: int = BLOCKS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b), repeated, that connect exactly the distinct fingerprints (column fp) at most `radius` bits apart.

    Every (choice of blocks, their value) is a shard, and every shard has its BK-trees, grown in the task that holds
    its fingerprints. With five blocks and radius 2 a fingerprint is in ten shards named by 38 of its 64 bits, so that the
    shards of 10^11 fingerprints that are spread evenly have few members. A shard of more than `shard_rows` is cut
    into tiles, as link_groups() tells, and each tile grows its own trees.
    """
    if not 0 <= radius < blocks:
        raise ValueError("blocks must be more than radius")
    masks = shard_masks(radius, blocks)
    keys = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("block", "value"))
    shards = keys.select(F.xxhash64("block", "value").alias("shard"), "fp")  # shards of one hash are searched together
    return link_groups(shards, "shard", "fp", shard_rows, lambda tile: tree_links([(x, root, x) for x, root in tile], radius))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most `radius` differing bits, itself included;
    equal fingerprints are linked. Null and empty texts have the fingerprint zero and are linked like any other. A
    null doc_id is never a component's name unless all of its members have none (then component_id is null). Repeated
    rows stay repeated; an empty table gives none. Other columns are not read.
    """
    prints = cut(fingerprints(docs, doc_id, text, width))
    named = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = cut(connected_components(fingerprint_links(named.select("fp"), radius, blocks), "a", "b").withColumnRenamed("node", "fp"))
    least = cut(roots.join(named.select("fp", "first_id"), "fp").groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n")))
    linked = join_counted(roots, least, ["root"]).select("fp", "least_id")
    names = cut(named.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), "n"))
    return join_counted(prints, names, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
