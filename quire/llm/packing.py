"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, arrow_map, word_count, words_of

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ROWS = 20_000
#: Texts of a shard, if they are carried, are about so many characters at most (or one piece).
SHARD_CHARS = 16 << 20


def bin_cost(capacity: int, overhead: int = 64, span: int = 8192) -> float:
    """What a sequence costs to train: a fixed part, a linear one and a quadratic one (attention)."""
    return overhead + capacity * (1 + capacity / span)


class OpenBins:
    """The open bins by the room they have left; an integer with a bit for each room makes best fit one bit scan."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0

    def put(self, room: int, at: int) -> None:
        self.by_room.setdefault(room, []).append(at)
        self.rooms |= 1 << room

    def best(self, length: int) -> tuple[int, int] | None:
        """Takes out the bin with the least room that is enough: (room, bin)."""
        if not (fits := self.rooms >> length):
            return None
        room = length + (fits & -fits).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        return room, at


def filled(length: int, capacity: int, counts: list[int], there: int) -> int:
    """Tokens that a bin of this capacity opened for an item would get: always the longest open item that still fits.
    counts: open items of each length, this one taken out; there: an integer with a bit for each length that is open."""
    room, taken = capacity - length, {}
    while room and (fits := there & ((1 << (room + 1)) - 1)):
        n = fits.bit_length() - 1
        left = counts[n] - taken.get(n, 0)
        if left:
            some = min(left, room // n)
            taken[n] = taken.get(n, 0) + some
            room -= some * n
        there &= (1 << n) - 1
    return capacity - room


def opened_size(length: int, counts: list[int], there: int, capacities: tuple[int, ...], cost=bin_cost) -> int:
    """The permitted size that costs least for each token that it would get, cut down to what it then holds; the
    larger one on equal costs."""

    def rate(c: int) -> float:
        got = filled(length, c, counts, there)
        return cost(min(k for k in capacities if k >= got)) / got

    return min((c for c in capacities if c >= length), key=lambda c: (rate(c), -c))


def pack_sizes(lengths: list[int], order: list[int], capacities: tuple[int, ...], cost=bin_cost) -> tuple[list[tuple[int, int]], list[int]]:
    """Best fit, longest first (`order`), over one set of sizes: (bin, offset) of every item and the bins' fills."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    fills: list[int] = []
    counts, there = [0] * (capacities[-1] + 1), 0
    for n in lengths:
        counts[n] += 1
        there |= 1 << n
    free = OpenBins()
    for i in order:
        n = lengths[i]
        counts[n] -= 1
        if not counts[n]:
            there &= ~(1 << n)
        if found := free.best(n):
            room, at = found
        else:
            room = opened_size(n, counts, there, capacities, cost) if len(capacities) > 1 else capacities[0]
            at = len(fills)
            fills.append(0)
        placed[i] = at, fills[at]
        fills[at] += n
        if room > n:
            free.put(room - n, at)
    return placed, fills


def pack_shard(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, cost=bin_cost) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Best fit, longest first, over the permitted sizes jointly.

    Returns (bin, offset) for every item and (capacity, fill) for every bin, after each bin was made as small as its
    contents permit. Every set of sizes that holds the longest item is tried, all sizes together among them, and the
    cheapest plan is taken, so none of the sizes alone would have cost less. Items of equal length keep their order;
    of plans that cost the same the one with more sizes is taken. Lengths are 1 to the largest capacity.
    """
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest = lengths[order[0]] if order else 0
    best = None
    for n in range(len(capacities), 0, -1):
        for some in itertools.combinations(capacities, n):
            if some[-1] < longest:
                continue
            placed, fills = pack_sizes(lengths, order, some, cost)
            bins = [(next(c for c in capacities if c >= f), f) for f in fills]
            total = sum(cost(c) for c, _ in bins)
            if best is None or total < best[0] - 1e-9:
                best = total, placed, bins
    return best[1], best[2]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS, texts: bool = False) -> DataFrame:
    """One row per piece of a document: doc_id, row_id, piece, start, length, bin_id, capacity, position, bin_fill, and
    with texts=True the piece's text.

    Lengths are words. A document longer than the largest capacity is cut into pieces of that capacity and a rest;
    start is the piece's first word in the text, position its first place in the bin. row_id tells rows that repeat a
    document apart. A document without words (empty or null) has one row with length 0 and no bin. Repeated rows are
    packed each for itself, null ids included; an empty table gives none. Other columns are not read. capacity less
    bin_fill is a bin's waste.

    Every task packs the rows it has read in shards of up to `shard_rows` pieces (and SHARD_CHARS characters, if texts
    are carried), so nothing is shuffled, no key can be hot and memory is bounded; a shard wastes at most its last open
    bins. bin_id is made of partition, shard and bin, so a task that runs again gives the same rows.
    """
    top = max(capacities)
    kind = docs.schema[doc_id].dataType.simpleString()
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    known = kind if kind in kinds else "string"
    body = F.col(text).cast("string")
    read = docs.select(F.col(doc_id).cast(known).alias("doc_id"), body.alias("body") if texts else word_count(body).alias("body"))

    def cut_up(body) -> Iterator[tuple[int, str | None]]:
        """(length, text) of each piece."""
        n = len(words_of(body)) if texts else body
        if n <= top:
            yield n, body if texts else None
            return
        ends = [m.end() for m in re.finditer(WORD, body)] if texts else []
        for at in range(0, n, top):
            last = min(at + top, n) - 1
            yield last + 1 - at, body[ends[at - 1] if at else 0 : ends[last]] if texts else None

    def rows(it: Iterator[tuple]) -> Iterator[tuple]:
        part, shard, chars = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> Iterator[tuple]:
            if held:
                placed, bins = pack_shard([r[4] for r in held], capacities)
                for (*head, told), (at, position) in zip(held, placed):
                    yield *head, (part << 40) | (shard << 20) | at, bins[at][0], position, bins[at][1], told

        for number, (i, body) in enumerate(it):
            for piece, (length, told) in enumerate(cut_up(body)):
                row = i, (part << 40) | number, piece, piece * top, length
                if not length:
                    yield *row, None, None, None, None, told
                    continue
                held.append((*row, told))
                chars += len(told or "")
                if len(held) == shard_rows or chars > SHARD_CHARS:
                    yield from flush()
                    held, shard, chars = [], shard + 1, 0
        yield from flush()

    longs = ("row_id", "piece", "start", "length", "bin_id", "capacity", "position", "bin_fill")
    arrow = pa.schema([("doc_id", kinds[known]), *((c, pa.int64()) for c in longs), ("text", pa.string())])
    out = arrow_map(read, rows, f"doc_id {known}, {', '.join(f'{c} long' for c in longs)}, text string", arrow, 64 if texts else 512)
    return out if texts else out.drop("text")
