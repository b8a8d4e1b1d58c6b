"""Group spelling variants: pairs of words that differ by one inserted, deleted or replaced code point.

The machine that accepts such pairs is the composition of the vocabulary's acceptor, a
one-edit transducer and the acceptor again. While no edit is made both sides are in the
state that their common prefix leads to, so the composition falls apart by prefix:

* A prefix with few words starts a partition: the acceptor of what follows it is
  minimised, composed, and the pairs accepted from there are enumerated.
* A prefix with many words is not enumerated from. The states that its next edit leads
  to take exact equality from there on, so these pairs are found by the word without
  that code point as a key; and the words go on to the next longer prefix.

An edit is placed where two words first differ, so each pair is accepted once. Pairs are
reduced to a count and a best neighbour per word where they are found.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialise
from .common import arrow_schema, utf8

LENGTH, LEAST, RATIO, RARE = 5, 3, 2, 97
#: Words of a prefix that one partition enumerates; a task takes partitions of so many words on average.
PARTITION, TASK = 2_000, 20_000
#: Distinct words that a task holds before it gives their counts away.
_HELD = 300_000
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LENGTH)


# ------------------------------------------------------------------ vocabulary


def counts(docs: DataFrame, least: int = LEAST, rare: int = RARE) -> DataFrame:
    """``word, n``: runs of letters over all whole texts, some with a planted deletion."""

    def add(total: Counter, batch: pa.RecordBatch) -> None:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
            seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
            for word, n in Counter(_RUN.findall(text.lower().decode())).items():
                h = zlib.crc32(word.encode(), seed)
                if h % rare == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < LENGTH:
                        continue
                total[word] += n

    def run(batches):
        total: Counter = Counter()
        for batch in chain(batches, [None]):
            if batch is not None:
                add(total, batch)
            if total and (batch is None or len(total) > _HELD):
                yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, schema=schema)
                total.clear()

    schema = arrow_schema(docs, "word STRING, n BIGINT")
    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "word STRING, n BIGINT")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ------------------------------------------------------------------ one partition


class Acceptor:
    """Minimal acceptor of a sorted list of distinct words, built word by word."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        path, last = [0], ""  # states along the last word

        def settle(down_to: int) -> None:
            while len(path) > down_to + 1:
                state = path.pop()
                key = (self.final[state], *self.next[state].items())
                self.next[path[-1]][last[len(path) - 1]] = register.setdefault(key, state)

        for word in words:
            k = 0
            while k < len(last) and k < len(word) and last[k] == word[k]:
                k += 1
            settle(k)
            for c in word[k:]:
                self.next.append({})
                self.final.append(False)
                self.next[path[-1]][c] = len(self.next) - 1
                path.append(len(self.next) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)


class OneEdit:
    """The acceptor composed with one edit and with itself; ``pairs`` are what it accepts."""

    def __init__(self, words: list[str]):
        self.a = Acceptor(words)
        self._split: dict[int, list[tuple[str, str]]] = {}

    def common(self, x: int, y: int) -> list[str]:
        """Words that both states accept: what may follow once the edit is made."""
        out, todo, then, final = [], [(x, y, "")], self.a.next, self.a.final
        while todo:
            x, y, s = todo.pop()
            if final[x] and final[y]:
                out.append(s)
            nx, ny = then[x], then[y]
            todo += [(nx[c], ny[c], s + c) for c in nx if c in ny]
        return out

    def split(self, state: int) -> list[tuple[str, str]]:
        """Pairs accepted from here that differ in their first code point; found once for all ways to a state."""
        out = self._split.get(state)
        if out is None:
            out, then = [], self.a.next[state]
            letters = sorted(then)
            for i, c in enumerate(letters):
                to = then[c]
                for d in letters[i + 1 :]:  # replaced
                    out += [(c + s, d + s) for s in self.common(to, then[d])]
                if self.a.final[to] and self.a.final[state]:  # deleted, nothing follows
                    out.append((c, ""))
                after = self.a.next[to]
                for d in after:  # deleted, followed by another code point
                    if d != c and d in then:
                        out += [(c + d + s, d + s) for s in self.common(after[d], then[d])]
            self._split[state] = out
        return out

    def pairs(self):
        todo = [("", 0)]
        while todo:
            word, state = todo.pop()
            for x, y in self.split(state):
                yield word + x, word + y
            todo += [(word + c, t) for c, t in self.a.next[state].items()]


# ------------------------------------------------------------------ all partitions


def enumerated(partitions: DataFrame, tasks: int) -> DataFrame:
    """Neighbours within partitions ``prefix, word, n``."""
    schema = "word STRING, n_near BIGINT, best_n BIGINT, best_word STRING"
    arrow = arrow_schema(partitions, schema)

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("k", "ascending"), ("prefix", "ascending"), ("word", "ascending")])
        out: dict[str, list] = {f.name: [] for f in arrow}
        ks, prefixes, words, ns = (g.column(c).to_pylist() for c in ("k", "prefix", "word", "n"))
        lo = 0
        while lo < len(words):
            k, prefix, hi = ks[lo], prefixes[lo], lo
            while hi < len(words) and ks[hi] == k and prefixes[hi] == prefix:
                hi += 1
            if hi - lo > 1:
                n = dict(zip([w[k:] for w in words[lo:hi]], ns[lo:hi], strict=True))
                near: Counter = Counter()
                best: dict[str, tuple[int, str]] = {}
                for pair in OneEdit(list(n)).pairs():
                    for x, y in (pair, pair[::-1]):
                        near[x] += 1
                        b = (-n[y], y)
                        if x not in best or b < best[x]:
                            best[x] = b
                for x, b in best.items():
                    for c, v in zip(out, (prefix + x, near[x], -b[0], prefix + b[1]), strict=True):
                        out[c].append(v)
            lo = hi
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in arrow}, schema=arrow)

    dealt = partitions.withColumn("task", F.pmod(F.xxhash64("k", "prefix"), F.lit(tasks)))
    found = dealt.repartition(tasks, "task").groupBy("task").applyInArrow(run, schema)
    return found.select("word", "n_near", F.struct(F.col("best_n").alias("n"), F.col("best_word").alias("word")).alias("best"))


def crossing(words: DataFrame, k: int) -> DataFrame:
    """Neighbours that share the first ``k`` code points of a word and differ in the next.

    The key of a group is a word without that code point; a group holds one word for each
    letter there may be, and the key itself if it is a word."""
    without = F.concat(F.substring("word", 1, k), F.substring(F.col("word"), F.lit(k + 2), F.length("word")))
    cut = words.where(F.length("word") > k).select(without.alias("key"), F.substring("word", k + 1, 1).alias("c"), "n", "word")
    both = cut.unionByName(words.select(F.col("word").alias("key"), F.lit("").alias("c"), "n", "word"))
    groups = both.groupBy("key").agg(F.collect_list(F.struct("c", "n", "word")).alias("all")).where(F.size("all") > 1)
    following = F.substring("key", k + 1, 1)
    each = groups.select("all", following.alias("following"), F.explode("all").alias("own"))
    # a word without its code point c, where c follows: the two first differ further on
    later = lambda a, b: (a["c"] == "") & (b["c"] == F.col("following"))
    near = F.filter("all", lambda o: (o["word"] != F.col("own.word")) & ~later(F.col("own"), o) & ~later(o, F.col("own")))
    each = each.select(F.col("own.word").alias("word"), near.alias("near")).where(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda o: F.struct((-o["n"]).alias("n"), o["word"].alias("word"))))
    each = each.select("word", F.size("near").cast("bigint").alias("n_near"), best.alias("best"))
    return each.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def neighbours(vocabulary: DataFrame, partition: int = PARTITION, task: int = TASK) -> DataFrame:
    """``word, n_near, best``: how many words are one edit away, and the one of largest ``n`` (ties: the smaller).

    ``vocabulary`` holds ``word, n`` with distinct words and is read several times.
    """
    rest, k, small, found = vocabulary.select("word", "n"), 0, [], []
    while True:
        at = rest.withColumns({"k": F.lit(k), "prefix": F.substring("word", 1, k)})
        large = materialise(at.groupBy("prefix").count().where(F.col("count") > partition).select("prefix"), "prefixes")
        if large.isEmpty():
            small.append(at)
            break
        small.append(at.join(large, "prefix", "left_anti").select(*at.columns))
        rest = materialise(at.join(large, "prefix", "left_semi").select("word", "n"), "frequent-prefixes")
        found.append(crossing(rest, k))
        rest = rest.where(F.length("word") > k)
        k += 1
    partitions = small[0]
    for s in small[1:]:
        partitions = partitions.unionByName(s)
    partitions = materialise(partitions, "partitions")
    out = enumerated(partitions, max(1, -(-partitions.count() // task)))
    for f in found:
        out = out.unionByName(f)
    best = F.min(F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")))
    out = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: pointers are doubled until all have reached their end."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group(vocabulary: DataFrame, ratio: int = RATIO, partition: int = PARTITION, task: int = TASK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a vocabulary ``word, n`` of distinct words.

    A word's ``form`` is its near word of largest ``n``, if that is ``ratio`` times its own or more.
    """
    v = vocabulary.select("word", "n").join(neighbours(vocabulary, partition, task), "word", "left")
    is_form = F.col("best.n") >= ratio * F.col("n")
    v = v.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, F.col("best.n")).alias("form_n"))
    v = materialise(v, "forms")
    to = roots(v.where("form IS NOT NULL"))
    return v.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, ratio: int = RATIO, partition: int = PARTITION, task: int = TASK) -> DataFrame:
    """``group`` over the words of all whole texts.

    * Words are runs of Latin letters, A-Z lower-cased; one run in 97, by the checksum of
      ``<doc_id>:<run>``, has a code point deleted. Words of under 5 code points or under 3 occurrences are left out.
    * Null, empty or letterless texts have no words. A null ``doc_id`` counts as empty in the checksum.
    * Repeated rows are documents of their own: their words count again. Very long texts and runs are whole.
    * An empty table gives no rows. Other columns are not read.
    """
    return group(materialise(counts(docs), "vocabulary"), ratio, partition, task)


def op13_variants(spark, sf_dir):
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
