"""Substring dedup with prefix-partitioned suffix trees, over words.

Anchors are the least hashed k-word runs of the windows (each window has one). The
suffix that begins at an anchor is dealt out by its prefix: ``PREFIX`` words at first;
where that many words are still too frequent for one group's memory, the prefix grows
to the whole window, at which depth the node is deep already and need only be counted.
Every other group builds its subtree (sorted suffixes and what neighbours share);
its nodes at the depth of a window, together with the words before the anchor,
are the repeats. Anchors whose prefix occurs once are no one's repeat and go early.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import map_batches, utf8, words
from .repeats import Anchors, Units, remove, seen_elsewhere
from .wordhash import WordHashes, factors, runs

WINDOW = 35
PREFIX = 8
_FACTORS = factors(PREFIX)
_KNOWN = WordHashes()


def anchors(units: list[bytes]) -> Anchors:
    """The leftmost least run of ``PREFIX`` words of each window."""
    n_windows = len(units) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n_windows < 1:
        return Anchors(none, np.zeros(0, np.uint64), none, none)
    h = runs(_KNOWN.of(units), PREFIX, _FACTORS)
    span = WINDOW - PREFIX + 1
    views = np.lib.stride_tricks.sliding_window_view(h, span)
    at = np.concatenate([views[k : k + 8192].argmin(1) + np.arange(k, min(k + 8192, n_windows)) for k in range(0, n_windows, 8192)])
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    pos = at[first]
    return Anchors(pos, h[pos], first, np.r_[first[1:] - 1, n_windows - 1])


def numbers(joined: list[bytes]) -> list[np.ndarray]:
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(w, len(known) + 1) for w in x.split(b" ")], np.uint32) for x in joined]


WORDS = Units(
    width=WINDOW,
    split=bytes.split,
    join=b" ".join,
    anchors=anchors,
    digest=lambda text: F.sha2(F.array_join(words(text), " "), 256),
    numbers=numbers,
)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sha, cls`` and the anchors' ``keys`` and ``again`` (twice in the text), per row."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "n", "sha", "cls", "keys", "again")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
            units = text.split()
            digest = hashlib.sha256(b" ".join(units))
            key = anchors(units).key
            _, of, count = np.unique(key, return_inverse=True, return_counts=True)
            row = (doc_id, len(units), digest.hexdigest(), int.from_bytes(digest.digest()[:8], "little", signed=True), key.view(np.int64), count[of] > 1)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
            if len(out["n"]) == 1000:
                yield out
                out = {k: [] for k in out}
        if out["n"]:
            yield out

    schema = "doc_id BIGINT, n BIGINT, sha STRING, cls BIGINT, keys ARRAY<BIGINT>, again ARRAY<BOOLEAN>"
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema)


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, n_spans, kept_sha256``, one row per row of ``docs``.

    * A null text has no words; texts shorter than a window keep all.
    * Of texts that are equal word for word, as long as a window, nothing is kept.
    * A passage that repeats within one document goes at all its places.
    * A null ``doc_id`` and rows that repeat others are documents like any other.
    * Other columns are not read. An empty table gives no rows.
    """
    t = materialise(scan(docs).withColumn("uid", F.monotonically_increasing_id()), "substring")
    keys = t.select("uid", "cls", F.posexplode(F.arrays_zip("keys", "again")).alias("i", "x"))
    live = seen_elsewhere(keys.select("uid", "cls", "i", F.col("x.keys").alias("key"), F.col("x.again").alias("again")))
    live = materialise(live.select("uid", "i", "key"), "substring-live")
    return remove(docs, t, live, WORDS, "substring").withColumnRenamed("n", "n_words")


def op5_substring(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_spans")
