"""What the two searches for repeated passages share.

Both look for windows of ``width`` units (words or bytes) that start in more than one
place. Each window has an anchor, a place that its own content decides, so equal windows
have equal anchors. ``Units`` says what a unit is; the two operators say how
anchors are found and which of them may lie in a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialise
from .common import arrow_schema, map_batches, utf8

#: Contexts of one anchor key that are compared in one group, some 30 MB; a key that has more is counted by its windows.
KEY_LIMIT = 60_000
#: Contexts in a group, on average.
GROUP_ROWS = 4_000
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Units:
    width: int
    split: Callable[[bytes], list | np.ndarray]  # text to units
    join: Callable[[list | np.ndarray], bytes]  # units to bytes
    anchors: Callable[[list | np.ndarray], "Anchors"]
    #: The class of equal unit sequences, as ``sha256`` of ``join(split(text))`` in lower-case hex.
    digest: Callable[[Column], Column]
    numbers: Callable[[list[bytes]], list[np.ndarray]]  # joined units to positive numbers, equal for equal units


@dataclass
class Anchors:
    pos: np.ndarray
    key: np.ndarray  # equal for the anchors of equal windows
    lo: np.ndarray  # first and last start of the windows whose anchor it is
    hi: np.ndarray
    places: int = 0  # anchors that are places; the others come after them


def window_names(units, starts, u: Units) -> list[bytes]:
    return [xxhash.xxh3_128_digest(u.join(units[s : s + u.width])) for s in starts]


def contexts(rows: DataFrame, u: Units) -> DataFrame:
    """From texts with their live anchors (``live``: index, ``big``: counted by windows) the
    pieces to compare: ``uid, key, pos, lo, hi, context`` or ``uid, lo, name``."""

    def run(batch):
        out: dict[str, list] = {k: [] for k in ("uid", "key", "pos", "lo", "hi", "context", "name")}
        held = 0
        for uid, text, live in zip(batch.column("uid").to_pylist(), utf8(batch, "text"), batch.column("live").to_pylist(), strict=True):
            units = u.split(text)
            a = u.anchors(units)
            for x in live:
                i, lo, hi = x["i"], int(a.lo[x["i"]]), int(a.hi[x["i"]])
                if x["big"]:
                    for s, name in zip(range(lo, hi + 1), window_names(units, range(lo, hi + 1), u), strict=True):
                        for k, v in zip(out, (uid, None, None, s, None, None, name), strict=True):
                            out[k].append(v)
                    held += 40 * (hi - lo + 1)
                else:
                    c = u.join(units[lo : hi + u.width])
                    for k, v in zip(out, (uid, int(a.key[i].view(np.int64)), int(a.pos[i]), lo, hi, c, None), strict=True):
                        out[k].append(v)
                    held += len(c)
            if held > 4 << 20:
                yield out
                out, held = {k: [] for k in out}, 0
        if out["uid"]:
            yield out

    return map_batches(rows, run, "uid BIGINT, key BIGINT, pos INT, lo INT, hi INT, context BINARY, name BINARY")


def common_prefix(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (key, row), and how much each shares with the one before; -1 where the key changes."""
    be = rows.astype(rows.dtype.newbyteorder(">")) if rows.dtype.itemsize > 1 else rows
    raw = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), np.ascontiguousarray(be).view(np.uint8).reshape(len(rows), -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel(), kind="stable")
    shared = np.full(len(rows), -1)
    for k in range(1, len(rows), 4096):
        a, b = order[k - 1 : k + 4095], order[k : k + 4096]
        a = a[: len(b)]
        differs = rows[a] != rows[b]
        first = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
        shared[k : k + len(b)] = np.where(key[a] == key[b], first, -1)
    return order, shared


def repeated_starts(key, pos, lo, hi, seqs: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Members and starts of the windows that another member has too.

    Suffixes from the anchor on are sorted, prefixes before it likewise. A window with
    ``d`` units before its anchor is repeated if another one lies under the same node of
    depth ``width - d`` in the tree of suffixes and under the same node of depth ``d`` on the
    other side. A node of depth x is a run of sorted neighbours that share x units.
    """
    m, before = len(pos), pos - lo
    after = np.array([len(s) for s in seqs]) - before
    dtype = np.uint8 if seqs[0].dtype == np.uint8 else np.uint32
    right, left = np.zeros((m, int(after.max())), dtype), np.zeros((m, max(1, int(before.max()))), dtype)
    for i, s in enumerate(seqs):
        right[i, : after[i]] = s[before[i] :]
        left[i, : before[i]] = s[: before[i]][::-1]
    r_order, r_shared = common_prefix(right, key)
    l_order, l_shared = common_prefix(left, key)
    who, start = [], []
    node_r, node_l = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int((pos - hi).min()), int(before.max()) + 1):
        some = np.flatnonzero((pos - hi <= d) & (d <= before))
        if len(some) < 2:
            continue
        node_r[r_order] = np.cumsum(r_shared < width - d)
        node_l[l_order] = np.cumsum(l_shared < d)
        _, of, count = np.unique(node_r[some] * (m + 1) + node_l[some], return_inverse=True, return_counts=True)
        twice = some[count[of] > 1]
        who.append(twice)
        start.append(pos[twice] - d)
    return (np.concatenate(who), np.concatenate(start)) if who else (np.zeros(0, int), np.zeros(0, int))


def spans(who: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one member as half-open spans of units."""
    o = np.lexsort((start, who))
    who, start = who[o], start[o]
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (start[1:] > start[:-1] + 1)]) if len(who) else np.zeros(0, int)
    last = np.r_[first[1:] - 1, len(who) - 1] if len(who) else first
    return who[first], start[first], start[last] + width


def resolve(pieces: DataFrame, u: Units) -> DataFrame:
    """``uid, a, b``: spans of units that repeated windows cover."""
    small = pieces.where("context IS NOT NULL")
    groups = int(max(64, small.count() // GROUP_ROWS))

    def group(g: pa.Table) -> pa.Table:
        key = g.column("key").to_numpy().view(np.uint64)
        pos, lo, hi = (g.column(c).to_numpy().astype(np.int64) for c in ("pos", "lo", "hi"))
        seqs = u.numbers([x.as_py() for x in g.column("context")])
        who, a, b = spans(*repeated_starts(key, pos, lo, hi, seqs, u.width), u.width)
        uid = g.column("uid").to_numpy()
        return pa.table({"uid": pa.array(uid[who], pa.int64()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    found = small.withColumn("bin", F.pmod("key", F.lit(groups))).drop("name").groupBy("bin").applyInArrow(group, "uid BIGINT, a INT, b INT")
    named = pieces.where("name IS NOT NULL").select("uid", "lo", "name")
    twice = named.groupBy("name").count().where("count > 1").select("name")
    counted = named.join(twice, "name").select("uid", F.col("lo").alias("a"), (F.col("lo") + u.width).alias("b"))
    return found.unionByName(counted)


def remove(docs: DataFrame, t: DataFrame, live: DataFrame, u: Units, name: str) -> DataFrame:
    """Take the repeated windows out: ``doc_id, n, n_removed, n_spans, kept_sha256``.

    ``t``: ``uid, doc_id, n, sha`` of every row; ``live``: ``uid, i, key`` of
    the anchors that may lie in a repeat. Equal texts are compared once; if they are
    as long as a window, all of each is repeated.
    """
    by_id = t.groupBy("sha", "doc_id").agg(F.min("uid").alias("uid"), F.count("*").alias("rows"))
    classes = by_id.groupBy("sha").agg(
        F.min_by(F.struct("doc_id"), "uid").alias("x"), F.min("uid").alias("uid"), F.sum("rows").alias("copies"), F.max("rows").alias("most")
    )
    classes = materialise(classes.select("sha", "uid", "x.doc_id", "copies", "most"), f"{name}-classes")
    of_class = live.join(classes.select("uid"), "uid")  # one text of each class
    keys = of_class.groupBy("key").count().where(F.col("count") > KEY_LIMIT).select("key", F.lit(True).alias("big"))
    of_class = of_class.join(keys, "key", "left")
    per = of_class.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("big", F.lit(False)).alias("big")))).alias("live"))
    wanted = classes.join(per, "uid").select("sha", "uid", "doc_id", "live")
    no_id = -(1 << 63)
    side = lambda d: F.coalesce(d["doc_id"].cast("bigint"), F.lit(no_id)).alias("_id")
    texts = docs.select(side(docs), "text", u.digest(F.coalesce("text", F.lit(""))).alias("sha"))
    texts = texts.join(wanted.select("*", side(wanted)).drop("doc_id"), ["sha", "_id"]).drop("_id")
    if (classes.agg(F.max("most")).head()[0] or 1) > 1:  # rows that repeat others
        texts = texts.dropDuplicates(["uid"])
    texts = materialise(texts, f"{name}-texts")
    pieces = materialise(contexts(texts.select("uid", "text", "live"), u), f"{name}-pieces")
    marked = resolve(pieces, u).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(batch):
        out: dict[str, list] = {k: [] for k in ("sha", "n_removed", "n_spans", "kept_sha256")}
        for sha, text, found in zip(batch.column("sha").to_pylist(), utf8(batch, "text"), batch.column("spans").to_pylist(), strict=True):
            units = u.split(text)
            edge = np.zeros(len(units) + 1, np.int64)
            np.add.at(edge, [x["a"] for x in found], 1)
            np.add.at(edge, [x["b"] for x in found], -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept = units[~gone] if isinstance(units, np.ndarray) else [x for x, g in zip(units, gone.tolist(), strict=True) if not g]
            row = (sha, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(u.join(kept)).hexdigest())
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        yield out

    done = map_batches(texts.select("uid", "sha", "text").join(marked, "uid").drop("uid"), cut, "sha STRING, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING")
    per_class = classes.select("sha", "copies").join(done, "sha", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= u.width)
    pick = lambda all_, some: F.when(whole, F.lit(all_)).otherwise(F.coalesce(*some))
    return t.select("doc_id", "n", "sha").join(per_class, "sha").select(
        "doc_id",
        "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        pick(1, ["n_spans", F.lit(0)]).cast("bigint").alias("n_spans"),
        pick(NOTHING, ["kept_sha256", "sha"]).alias("kept_sha256"),
    )


def seen_elsewhere(rows: DataFrame, name: str = "key") -> DataFrame:
    """Rows whose ``name`` occurs in another text (``cls``) or twice in its own (``again``).

    Counts are merged before the network; the join back may be split at frequent names."""
    met = rows.groupBy(name).agg(F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.max("again").alias("a"))
    return rows.join(met.where("c0 <> c1 OR a").select(name), name)


def ranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows whose ``by`` (longs) another row has too, with ``rank``, the dense rank of ``by`` among all rows.

    Spark sorts the rows by ``by``, ``uid`` and ``i`` over ranges, so that a frequent value
    is spread over several tasks. Each task numbers its distinct values and drops those of one
    row, but for its first and last row; prefix sums of the tasks' counts, less
    the values that go on from one task to the next, make the numbers ranks.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{fields}, pid INT, rank BIGINT, twice BOOLEAN"
    arrow, columns = arrow_schema(rows, schema), rows.columns

    def number(batches):
        pid, rank, last, held, first = TaskContext.get().partitionId(), 0, None, None, True
        for batch in chain(batches, [None]):  # the last row waits for the one after it
            some = [x for x in (held, batch) if x is not None and x.num_rows]
            if not some:
                continue
            t = pa.Table.from_batches(some).combine_chunks()
            v = np.stack([t.column(c).to_numpy() for c in by])
            n = t.num_rows
            done = n if batch is None else n - 1
            new = np.ones(n + 1, bool)  # the value is not that of the row before
            new[1:n] = (v[:, 1:] != v[:, :-1]).any(0)
            if last is not None:
                new[0] = (v[:, 0] != last).any()
            if done:
                ranks = rank + np.cumsum(new[:done])
                twice = ~(new[:done] & new[1 : done + 1])
                keep = twice.copy()
                keep[0] |= first
                keep[-1] |= batch is None
                at = np.flatnonzero(keep)
                rank, last, first = int(ranks[-1]), v[:, done - 1], False
                if len(at):
                    out = t.select(columns).take(at)
                    for c, x in (("pid", np.full(len(at), pid, np.int32)), ("rank", ranks[at]), ("twice", twice[at])):
                        out = out.append_column(c, pa.array(x))
                    yield from out.cast(arrow).to_batches()
            held = t.slice(done).to_batches()[0] if done < n else None

    order = [*by, "uid", "i"]
    local = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    value, by_task = F.struct(*by), Window.orderBy("pid")
    ends = local.groupBy("pid").agg(F.min(value).alias("a"), F.max(value).alias("z"), F.max("rank").alias("values"))  # a row per task
    ends = ends.withColumns({
        "goes_back": F.coalesce(F.col("a") == F.lag("z").over(by_task), F.lit(False)),
        "goes_on": F.coalesce(F.col("z") == F.lead("a").over(by_task), F.lit(False)),
    })
    before = F.sum(F.col("values") - F.col("goes_back").cast("bigint")).over(by_task) - F.col("values")
    ends = ends.select("pid", "values", "goes_back", "goes_on", before.alias("before"))
    shared = F.expr("twice OR (rank = 1 AND goes_back) OR (rank = values AND goes_on)")
    found = local.join(F.broadcast(ends), "pid").where(shared)
    return found.select(*columns, (F.col("before") + F.col("rank")).alias("rank"))
