"""Pack documents whole into sequences of bounded length: best-fit decreasing.

Documents are tokenised once and, where longer than a sequence, cut into pieces. Pieces
are dealt by hash into groups of bounded size, so that each group has the lengths of the
whole table. Within a group the longest piece goes first, each into the open sequence
with the least room that is enough; a segment tree over the remaining capacities finds
it in logarithmic time. What a group leaves with room is dealt anew with what the other
groups left, until one group is enough or nothing is gained.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import arrow_schema, map_batches
from .packing import TOKENIZER, tokenise

END = 1
WINDOW = 4096
#: Tokens and pieces that a group holds on average.
GROUP_TOKENS, GROUP_ROWS = 1 << 22, 100_000
#: A sequence with room for more than one part in so many is packed anew.
SLACK = 64
#: Bytes of ids in one output batch.
_CHUNK = 4 << 20


class OpenBins:
    """Segment tree over the remaining capacities ``0..window``: a node says whether an
    open bin has a capacity within its range."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        at = self.leaves + capacity
        while at and not self.any[at]:
            self.any[at] = True
            at >>= 1

    def tightest(self, need: int) -> int:
        """The least capacity of an open bin that is not below ``need``; -1 if there is none."""
        at = self.leaves + need
        while not self.any[at]:
            # up to the first range on the right that has a bin
            while at & 1:
                at >>= 1
                if at <= 1:
                    return -1
            at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves

    def take(self, capacity: int) -> int:
        bin_ = self.bins[capacity].pop()
        if not self.bins[capacity]:
            at = self.leaves + capacity
            self.any[at] = False
            while at > 1 and not self.any[at ^ 1]:
                at >>= 1
                self.any[at] = False
        return bin_


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """``bin`` and ``offset`` of each length, longest first in the order given, and the room left in each bin."""
    open_, room = OpenBins(window), []
    bins, offsets = [], []
    for n in lengths:
        capacity = open_.tightest(n)
        if capacity < 0:
            bin_, capacity = len(room), window
            room.append(window)
        else:
            bin_ = open_.take(capacity)
        bins.append(bin_)
        offsets.append(window - capacity)
        room[bin_] = capacity - n
        if capacity > n:
            open_.add(capacity - n, bin_)
    return bins, offsets, room


def cut(docs: DataFrame, path: str, window: int, ids: bool) -> DataFrame:
    """``doc_id, part, at, piece, start, length, ids_crc32`` and, if asked for, ``ids``; ``part, at, piece`` is a key."""

    def run(batch):
        names = ("doc_id", "part", "at", "piece", "start", "length", "ids_crc32", "ids")
        out: dict[str, list] = {k: [] for k in names}
        held = 0
        for doc_id, part, at, raw in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "part", "start", "ids")), strict=True):
            tokens = np.frombuffer(raw, "<u2").astype("<u4")
            for piece, start in enumerate(range(0, len(tokens), window)):
                some = tokens[start : start + window].tobytes()
                for k, v in zip(names, (doc_id, part, at, piece, start, len(some) // 4, zlib.crc32(some), some if ids else None), strict=True):
                    out[k].append(v)
                held += len(some) if ids else 64
            if held > _CHUNK:
                yield out
                out, held = {k: [] for k in names}, 0
        if out["part"]:
            yield out

    schema = "doc_id BIGINT, part INT, at BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT, ids BINARY"
    pieces = map_batches(tokenise(docs, path, special=True, end_id=END), run, schema)
    return pieces if ids else pieces.drop("ids")


def place(pieces: DataFrame, groups: int, window: int) -> DataFrame:
    """``pieces`` with ``group, bin, offset`` and ``room``, what is left in the bin."""
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("part", "at", "piece"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", bin INT, offset BIGINT, room INT"
    arrow = arrow_schema(pieces, schema)

    def fill(g: pa.Table) -> pa.Table:
        g = g.sort_by([("length", "descending"), ("part", "ascending"), ("at", "ascending"), ("piece", "ascending")])
        bins, offsets, room = best_fit_decreasing(g.column("length").to_pylist(), window)
        left = [room[b] for b in bins]
        return pa.table([*g.columns, pa.array(bins, pa.int32()), pa.array(offsets, pa.int64()), pa.array(left, pa.int32())], schema=arrow)

    return dealt.repartition(groups, "group").groupBy("group").applyInArrow(fill, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, ids: bool = True, group_tokens: int = GROUP_TOKENS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, its ``ids``.

    Only documents of more than ``window`` tokens are cut. ``sequence_id`` tells sequences apart and has no order.

    * A null or empty text gives the end id alone; very long texts are read and cut whole.
    * A null ``doc_id`` and repeated rows are ordinary documents; equal lengths go in the order of reading.
    * An empty table gives no pieces. Other columns are not read.
    * Special tokens spelled out in a text have the ids of the tokenizer file.
    """
    left = materialise(cut(docs, path or public_tokenizers.path(TOKENIZER), window, ids), "pieces")
    columns = left.columns

    def wanted(df: DataFrame) -> int:
        rows, tokens = df.agg(F.count("*"), F.sum("length")).head()
        return max(-(-(tokens or 0) // group_tokens), -(-rows // group_rows))

    groups, done, turn = wanted(left), [], 0
    while True:
        placed = materialise(place(left, max(groups, 1), window), "placed")
        numbered = placed.withColumn("sequence_id", F.lit(turn << 56) + F.shiftleft("group", 24) + F.col("bin"))
        roomy = F.col("room") > window // SLACK
        again = wanted(placed.where(roomy))
        if groups <= 1 or not again or again > groups // 2:  # few would gain little from a new deal
            done.append(numbered)
            break
        done.append(numbered.where(~roomy))
        left, groups, turn = placed.where(roomy).select(columns), again, turn + 1
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else []))


def op12_best_fit(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
