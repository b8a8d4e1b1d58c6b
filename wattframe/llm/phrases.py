"""Phrases whose words occur together more often than apart, per language.

Documents of a language are gathered into shards of bounded size, each a sequence of word
ids with a mark where phrases end. A shard has a bidirectional FM-index over its word ids:
transforms of the sequence and of its reverse, sorted as deep as phrases are extended.

* The interval of a word, extended to the left, enumerates the two-word phrases with
  their counts. Counts are summed across shards.
* Phrases that are frequent over all shards go back to the shards that hold them. There
  each is found by backward search and its interval is extended to the right, only to
  phrases whose other part is frequent too. Their counts are summed again, and so on.

A word is known across shards by a 64-bit hash of language and word; that no two words
share one is checked, and another seed taken if they do.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import arrow_schema, utf8

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Words in a shard.
SHARD_WORDS = 2_000_000
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TOKEN = re.compile(rb"[^ \t" + re.escape(_ENDS) + rb"]+|[" + re.escape(_ENDS) + rb"]")
#: Rows in one output batch.
_ROWS = 500_000


# ------------------------------------------------------------------ shards


class _Ids(dict):
    """Ids of words in the order they are met, from 1; 0 ends a phrase."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - len(_ENDS) + 1
        return n


class _Open:
    """A shard that still takes documents."""

    def __init__(self):
        self.ids, self.parts = _Ids({bytes([c]): 0 for c in _ENDS}), []

    def add(self, text: bytes) -> int:
        found = _TOKEN.findall(text.lower())
        self.parts += [np.fromiter(map(self.ids.__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32)]
        return len(found)

    def columns(self, lang: str, seed: int) -> dict:
        s, words = np.concatenate(self.parts), list(self.ids)[len(_ENDS) :]
        n = np.bincount(s, minlength=len(words) + 1)[1:]
        order = np.argsort(-n, kind="stable")  # frequent words have small ids
        new = np.zeros(len(words) + 1, np.int32)
        new[order + 1] = np.arange(1, len(words) + 1, dtype=np.int32)
        words, head = [words[i] for i in order], lang.encode() + b"\0"
        keys = [xxhash.xxh3_64_intdigest(head + w, seed) for w in words]
        return {"lang": lang, "words": words, "keys": np.array(keys, np.uint64).view(np.int64), "counts": n[order], "stream": packed(new[s])}


def packed(s: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(s.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def shards(docs: DataFrame, size: int = SHARD_WORDS, seed: int = 0) -> DataFrame:
    """``shard, lang, words, keys, counts, stream``: word ids are places in ``words`` from 1."""

    def run(batches):
        base, no, held = TaskContext.get().partitionId() << 32, 0, 0
        open_: dict[str, _Open] = {}
        for batch in chain(batches, [None]):
            texts = [] if batch is None else zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True)
            for lang, text in chain(texts, [(None, None)] if batch is None else []):
                if text is not None:
                    held += open_.setdefault(UNKNOWN if lang is None else lang, _Open()).add(text)
                if open_ and (text is None or held >= size):
                    for k, o in open_.items():
                        if len(o.ids) > len(_ENDS):
                            c = o.columns(k, seed)
                            words = pa.array([c["words"]], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
                            row = [pa.array([base + no]), pa.array([k]), words, pa.array([c["keys"]], pa.list_(pa.int64())), pa.array([c["counts"]], pa.list_(pa.int64())), pa.array([c["stream"]])]
                            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(row, schema, strict=True)], schema=schema)
                            no += 1
                    open_, held = {}, 0

    ddl = "shard BIGINT, lang STRING, words ARRAY<STRING>, keys ARRAY<BIGINT>, counts ARRAY<BIGINT>, stream BINARY"
    schema = arrow_schema(docs, ddl)
    return docs.select("lang", "text").mapInArrow(run, ddl)


# ------------------------------------------------------------------ the index of a shard


class Index:
    """FM-index of a sequence and of its reverse, for phrases of up to ``depth`` words and one more.

    Rows of ``back`` stand for the suffixes in order and hold the word before each; rows of
    ``forth`` stand for the reversed prefixes and hold the word after each.
    """

    def __init__(self, s: np.ndarray, size: int, depth: int, back: bool = True, forth: bool = True):
        self.size, self.n = size, len(s)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=size))))
        self.back = self._transform(s, depth) if back else None
        self.forth = self._transform(s[::-1], depth) if forth else None
        self._ranks: dict[int, np.ndarray] = {}

    def _transform(self, s: np.ndarray, depth: int) -> np.ndarray:
        order = np.arange(self.n)
        for k in range(depth - 1, -1, -1):  # stable sorts, the first word last
            order = order[np.argsort(s[(order + k) % self.n], kind="stable")]
        return s[order - 1]

    def words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of single words; the same in both directions."""
        return self.first[ids], self.first[ids + 1]

    def extend(self, rows: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more word ``c``, by counting it above their ends."""
        at = self._ranks.get(id(rows))
        if at is None:
            order = np.argsort(rows, kind="stable")
            at = self._ranks[id(rows)] = rows[order].astype(np.int64) * self.n + order
        return np.searchsorted(at, c * self.n + lo), np.searchsorted(at, c * self.n + hi)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals in ``forth`` of phrases, one per line, read from their first word on."""
        lo, hi = self.words(phrases[:, 0])
        for k in range(1, phrases.shape[1]):
            lo, hi = self.extend(self.forth, phrases[:, k].astype(np.int64), lo, hi)
        return lo, hi

    def extensions(self, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which interval, the word that extends it, and how often; ends of phrases extend nothing."""
        n = hi - lo
        of = np.repeat(np.arange(len(lo)), n)
        c = rows[np.arange(len(of)) + np.repeat(lo - (np.cumsum(n) - n), n)]
        key = (of * self.size + c)[c > 0]
        key.sort()
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        return key[cut] // self.size, key[cut] % self.size, np.diff(np.r_[cut, len(key)])


def pairs_of(keys: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All two-word phrases of a shard, by keys, and their counts."""
    index = Index(s, len(keys) + 1, 1, forth=False)
    words = np.arange(1, len(keys) + 1)
    right, left, n = index.extensions(index.back, *index.words(words))
    return np.stack([keys[left - 1], keys[right]], 1), n


def longer(keys: np.ndarray, s: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of one more word, both of whose parts are among ``phrases`` (by keys), and their counts."""
    order = np.argsort(keys)
    local = order[np.searchsorted(keys, phrases, sorter=order)] + 1
    width = local.shape[1]
    index = Index(s, len(keys) + 1, width, back=False)
    of, word, n = index.extensions(index.forth, *index.find(local))
    grown = np.concatenate([local[of], word[:, None]], 1)
    good = np.isin(*_codes(grown[:, 1:], local, len(keys) + 1))
    return keys[grown[good] - 1], n[good]


def _codes(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each line of both, equal where the lines are."""
    both = np.concatenate([a, b])
    code = both[:, 0].astype(np.int64)
    for k in range(1, both.shape[1]):
        if k > 1:
            code = np.unique(code, return_inverse=True)[1]
        code = code * size + both[:, k]
    return code[: len(a)], code[len(a) :]


def _rows(phrases: np.ndarray, n: np.ndarray, schema: pa.Schema, shard: int | None = None):
    for k in range(0, len(n), _ROWS):
        some = slice(k, k + _ROWS)
        arrays = [phrases[some, j] for j in range(phrases.shape[1])] + [n[some]]
        if shard is not None:
            arrays.insert(0, np.full(len(arrays[0]), shard))
        yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


# ------------------------------------------------------------------ across shards


def _names(width: int) -> list[str]:
    return [f"k{j}" for j in range(1, width + 1)]


def _enumerate(schema: pa.Schema):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                keys = b.column("keys")[i].values.to_numpy(zero_copy_only=False)
                yield from _rows(*pairs_of(keys, unpacked(b.column("stream")[i].as_py())), schema, b.column("shard")[i].as_py())

    return run


def _grow(schema: pa.Schema, names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        phrases = np.stack([right.column(k).to_numpy() for k in names], 1)
        keys = left.column("keys")[0].values.to_numpy(zero_copy_only=False)
        made = _rows(*longer(keys, unpacked(left.column("stream")[0].as_py()), phrases), schema, left.column("shard")[0].as_py())
        return pa.Table.from_batches(list(made), schema)

    return run


def frequent(shard: DataFrame, longest: int, least: int) -> dict[int, DataFrame]:
    """By number of words: ``k1, .., f`` for all phrases that occur ``least`` times or more."""
    out: dict[int, DataFrame] = {}
    source, kept = shard.select("shard", "keys", "stream"), None
    for width in range(2, longest + 1):
        names = _names(width)
        ddl = "shard BIGINT, " + ", ".join(f"{k} BIGINT" for k in names) + ", n BIGINT"
        schema = arrow_schema(shard, ddl)
        if kept is None:
            local = source.mapInArrow(_enumerate(schema), ddl)
        else:
            local = source.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(_grow(schema, names[:-1]), ddl)
        if width < longest:  # each row learns the sum, and goes back to its shard
            total = local.withColumn("f", F.sum("n").over(Window.partitionBy(*names)))
            kept = materialise(total.where(F.col("f") >= least).select("shard", *names, "f"), f"phrases-{width}")
            sums = kept.groupBy(*names).agg(F.first("f").alias("f"))
        else:
            sums = local.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        out[width] = materialise(sums, f"frequent-{width}")
    return out


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of 2 to ``longest`` words per language.

    A phrase occurs ``a`` times, its two parts ``l`` and ``r`` times, where it is cut to score
    lowest; ``score`` is ``floor(1000000 a a / (l r))``. A phrase goes if ``share`` percent of it
    or more lie within one longer phrase that is frequent too.

    * Null, empty and wordless texts add nothing; a null ``lang`` is ``und``.
    * Repeated rows are documents of their own; ties are in the order of the phrase's bytes.
    * Very long texts are read whole; a shard ends after the document that fills it.
    * An empty table gives no rows. Other columns are not read.
    """
    for seed in range(8):
        shard = materialise(shards(docs, shard_words, seed), "shards")
        each = shard.select("lang", F.explode(F.arrays_zip("words", "keys", "counts")).alias("x")).select("lang", "x.*")
        words = materialise(each.groupBy("lang", F.col("words").alias("word"), F.col("keys").alias("key")).agg(F.sum("counts").alias("f")), "words")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share keys under every seed")
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = words.where(F.col("f") >= least)
    found = frequent(shard, longest, least)
    part = {1: known.select(F.col("key").alias("k1"), "f"), **found}
    scored = None
    for width, phrases in found.items():
        names, df = _names(width), phrases.withColumnRenamed("f", "a")
        for j in range(1, width + 1):
            one = known.select(F.col("key").alias(f"k{j}"), F.col("word").alias(f"w{j}"), *(["lang"] if j == 1 else []))
            df = df.join(one, f"k{j}")
        for k in range(1, width):
            left = part[k].select(*names[:k], F.col("f").alias(f"l{k}"))
            right = part[width - k].select(*[F.col(f"k{j}").alias(f"k{j + k}") for j in range(1, width - k + 1)], F.col("f").alias(f"r{k}"))
            df = df.join(left, names[:k]).join(right, names[k:])
        d = lambda c: F.col(c).cast("decimal(13,0)")
        cuts = [F.struct(F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (d("a") * d("a")), d(f"l{k}") * d(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, width)]
        cut = F.array_min(F.array(*cuts))
        for more in range(width + 1, longest + 1):  # the longer phrases around it
            for at in range(1, more - width + 2):
                around = found[more].groupBy(*[F.col(f"k{at + j}").alias(f"k{j + 1}") for j in range(width)]).agg(F.max("f").alias("longer"))
                df = df.join(around, names, "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")
        df = df.select("lang", F.concat_ws(" ", *[f"w{j}" for j in range(1, width + 1)]).alias("phrase"), "a", cut.alias("cut"))
        scored = df if scored is None else scored.unionByName(df)
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
t AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f1 AS (SELECT lang, w[i] AS w1, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, count(*) AS f FROM t WHERE i < len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS f FROM t WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
s2 AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * b.f * b.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND t.w1 = b.w1 AND t.w2 = b.w2 AND 100 * t.f >= 50 * b.f)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND t.w2 = b.w1 AND t.w3 = b.w2 AND 100 * t.f >= 50 * b.f)),
c3 AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 || ' ' || b.w3 AS phrase, b.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
    CAST(1000000::HUGEINT * b.f * b.f // (x.f::HUGEINT * yz.f) AS BIGINT) AS s1, CAST(1000000::HUGEINT * b.f * b.f // (xy.f::HUGEINT * z.f) AS BIGINT) AS s2
  FROM f3 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 z ON z.lang = b.lang AND z.w1 = b.w3
  JOIN f2 xy ON xy.lang = b.lang AND xy.w1 = b.w1 AND xy.w2 = b.w2 JOIN f2 yz ON yz.lang = b.lang AND yz.w1 = b.w2 AND yz.w2 = b.w3),
s AS (SELECT * FROM s2 UNION ALL SELECT lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM c3)
SELECT s.lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM s JOIN n ON n.lang = s.lang
WINDOW w AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000"""


def op11_phrases(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
