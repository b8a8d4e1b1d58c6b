"""Suffix-array dedup by distributed prefix doubling, over bytes.

Texts are cut at places that their bytes alone decide (the least hash among its
``REACH`` neighbours on either side), so equal passages are cut alike. The suffixes that
begin at such places are ranked by prefix doubling: rank 0 is the place of the phrase up
to the next place among all phrases in sorted order, rank k that of the pair of rank
k-1 here and 2^(k-1) phrases on. Phrases are sorted by their hashes, pairs by their
ranks. After each round a suffix whose rank is unique leaves; one that has reached the number
of phrases that any window from here must hold has passed the threshold. What is left
after that is compared byte by byte, which settles the ends between the places.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import map_batches, utf8
from .repeats import Anchors, Units, ranked, remove
from .wordhash import mix

WINDOW = 400
#: Bytes that are hashed at a place, and neighbours that it must not be greater than.
GRAM, REACH = 16, 48
#: Bytes on either side of a place that decide whether it is one.
_LEFT, _RIGHT = REACH, REACH + GRAM
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
_PIECE = 1 << 20


def grams(b: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` bytes, by doubling their length."""
    h, n, by = b.astype(np.uint64) + np.uint64(1), 1, _BASE
    while n < GRAM:
        h = h[:-n] * by + h[n:]
        n, by = 2 * n, by * by
    return mix(h)


def sliding_least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` neighbours."""
    x, have = h, 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def places(b: np.ndarray) -> np.ndarray:
    """Places whose hash no neighbour within ``REACH`` is below, with ``_LEFT`` and ``_RIGHT`` bytes around them."""
    out = []
    for k in range(0, max(1, len(b) - _LEFT - _RIGHT + 1), _PIECE):
        part = b[k : k + _PIECE + _LEFT + _RIGHT - 1]
        if len(part) < _LEFT + _RIGHT:
            break
        h = grams(part)
        least = sliding_least(h, 2 * REACH + 1)
        out.append(np.flatnonzero(h[REACH : REACH + len(least)] == least) + k + REACH)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def stretch_hashes(b: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A hash for each ``b[a:z]``; it only names candidates, which are compared in full later."""
    import xxhash

    raw = b.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)], np.uint64)


def anchors(b: np.ndarray) -> Anchors:
    """A window's anchor is the first place that lies in it with all the bytes that decide it.

    A window without any is anchored at its leftmost least run of ``GRAM`` bytes; such
    anchors follow the places.
    """
    n_windows, none = len(b) - WINDOW + 1, np.zeros(0, np.int64)
    if n_windows < 1:
        return Anchors(none, np.zeros(0, np.uint64), none, none)
    pos = places(b)
    last = np.r_[-1, pos[:-1] - _LEFT] if len(pos) else none
    lo, hi = np.maximum(last + 1, pos + _RIGHT - WINDOW), np.minimum(pos - _LEFT, n_windows - 1)
    lo = np.maximum(lo, 0)
    held = np.zeros(n_windows + 1, np.int64)
    some = hi >= lo
    np.add.at(held, lo[some], 1)
    np.add.at(held, hi[some] + 1, -1)
    key, more = stretch_hashes(b, pos - _LEFT, pos + _RIGHT), leftover_anchors(b, np.flatnonzero(np.cumsum(held)[:-1] == 0))
    return Anchors(*(np.concatenate(x) for x in zip((pos, key, lo, hi), more, strict=True)), places=len(pos))


def leftover_anchors(b: np.ndarray, starts: np.ndarray):
    """``pos, key, lo, hi`` for windows that hold no place."""
    found = []
    span = WINDOW - GRAM + 1
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    for run in np.split(starts, cut) if len(starts) else []:
        for k in range(0, len(run), 4096):
            s0, count = int(run[k]), min(4096, len(run) - k)
            h = grams(b[s0 : s0 + count - 1 + WINDOW])
            at = np.lib.stride_tricks.sliding_window_view(h, span).argmin(1) + np.arange(count)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:] - 1, count - 1]
            found.append((at[first] + s0, h[at[first]] ^ _BASE, first + s0, last + s0))
    none = np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [none, np.zeros(0, np.uint64), none, none]


def phrases(b: np.ndarray, a: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases from each place to the next (0 after the last), and how often the
    rank must be doubled: the largest k with 2^k phrases in every window of the place; -1 for
    none, and for anchors that are no places; -2 where no window is anchored."""
    pos = a.pos[: a.places]
    name = np.zeros(len(a.pos), np.uint64)
    if len(pos) > 1:
        name[: len(pos) - 1] = stretch_hashes(b, pos[:-1], pos[1:] + GRAM)
    inside = np.zeros(len(a.pos), np.int64)
    inside[: len(pos)] = np.searchsorted(pos, a.lo[: len(pos)] + WINDOW - _RIGHT, side="right") - 1 - np.arange(len(pos))
    depth = np.where(inside > 0, np.floor(np.log2(np.maximum(inside, 1))), -1)
    return name, np.where(a.hi >= a.lo, depth, -2).astype(np.int8)


BYTES = Units(
    width=WINDOW,
    split=lambda text: np.frombuffer(text, np.uint8),
    join=lambda units: units.tobytes(),
    anchors=anchors,
    digest=lambda text: F.sha2(F.encode(text, "UTF-8"), 256),
    numbers=lambda joined: [np.frombuffer(x, np.uint8) for x in joined],
)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sha`` and per place ``key, phrase, depth``, a row per row of ``docs``."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "sha", "keys", "phrase", "depth")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
            b = np.frombuffer(text, np.uint8)
            a = anchors(b)
            name, depth = phrases(b, a)
            row = (doc_id, len(text), hashlib.sha256(text).hexdigest(), a.key.view(np.int64), name.view(np.int64), depth)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
            if len(out["n"]) == 1000:
                yield out
                out = {k: [] for k in out}
        if out["n"]:
            yield out

    schema = "doc_id BIGINT, n BIGINT, sha STRING, keys ARRAY<BIGINT>, phrase ARRAY<BIGINT>, depth ARRAY<TINYINT>"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def doubling(t: DataFrame) -> DataFrame:
    """``uid, i, key`` of the places from which a window may be repeated; equal texts are ranked once."""
    first = t.groupBy("sha").agg(F.min("uid").alias("uid")).select("uid")
    zipped = F.posexplode(F.arrays_zip("keys", "phrase", "depth")).alias("i", "x")
    s = t.select("uid", "keys", "phrase", "depth").join(first, "uid", "left_semi").select("uid", zipped)
    s = s.select("uid", "i", F.col("x.keys").alias("bytes"), "x.phrase", "x.depth")
    s = ranked(s, ["bytes"], "places").drop("bytes").withColumnRenamed("rank", "key")
    found = s.where("depth = -1").select("uid", "i", "key")
    # rank 0 is that of the phrase itself; the last place of a text begins none
    rank, step = ranked(s.where("phrase <> 0"), ["phrase"], "rank-0").drop("phrase"), 0
    while True:
        found = found.unionByName(rank.where(F.col("depth") == step).select("uid", "i", "key"))
        if rank.where(F.col("depth") > step).isEmpty():
            return found
        hop = 1 << step
        on = F.max("rank").over(Window.partitionBy("uid").orderBy("i").rangeBetween(hop, hop))
        pairs = rank.withColumn("on", on).where("on IS NOT NULL").withColumnRenamed("rank", "here")
        step += 1
        rank = ranked(pairs, ["here", "on"], f"rank-{step}").drop("here", "on")


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``docs``.

    * A null text is empty; texts shorter than a window keep all.
    * Of equal texts as long as a window nothing is kept.
    * A passage that repeats within one document, overlapping itself or not, goes at all its places.
    * Kept bytes need not be valid UTF-8: a cut may fall within a character.
    * A null ``doc_id`` and rows that repeat others are documents like any other.
    * A very long text is read whole by one task; its places are then rows like all others.
    * Other columns are not read. An empty table gives no rows.
    """
    t = materialise(scan(docs).withColumn("uid", F.monotonically_increasing_id()), "suffixes")
    live = materialise(doubling(t), "suffixes-live")
    return remove(docs, t, live, BYTES, "suffixes").withColumnRenamed("n", "n_bytes")


def op8_suffix_array(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
