"""Collocations against counting in plain Python, and on awkward tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from wattframe.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000, least=10, longest=3, share=50):
    f: dict[str, Counter] = {}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                f.setdefault("und" if lang is None else lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in often.items():
            for width in range(2, len(p)):
                gone |= {p[i : i + width] for i in range(len(p) - width + 1) if 100 * a >= share * count[p[i : i + width]]}
        found = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def talk(n, seed, words="the of new york city Straße é go go. stop, a|b x;y\tz"):
    r = random.Random(seed)
    w = words.split(" ")
    return " ".join(r.choice(w) for _ in range(n)) + r.choice(["", " new york city", "\n", "!?"])


@pytest.mark.parametrize("size", [40, 2_000_000])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_counts_and_scores(spark, size, longest):
    table = [(("en", "de", None)[i % 3], talk(40, i)) for i in range(60)] + [("en", "new york city " * 30)]
    d = spark.createDataFrame(table, "lang STRING, text STRING")
    got = rows(phrases.collocations(d, least=4, longest=longest, shard_words=size))
    assert got == brute(table, least=4, longest=longest) and len(got) > 20


def test_index_counts_every_phrase():
    r = np.random.default_rng(1)
    s = r.integers(0, 6, 400).astype(np.int32)
    s[-1] = 0
    keys = np.array([50, 10, 40, 20, 30])
    text = [int(keys[x - 1]) if x else None for x in s]
    for width in (2, 3, 4):
        want = Counter(tuple(text[i : i + width]) for i in range(len(s) - width + 1) if None not in text[i : i + width])
        if width == 2:
            found, n = phrases.pairs_of(keys, s)
        else:
            found, n = phrases.longer(keys, s, found)
        assert dict(zip(map(tuple, found.tolist()), n.tolist(), strict=True)) == want


def test_top_and_ties(spark):
    table = [("en", ". ".join(f"a{i} b{i}" for i in range(30)))] * 12
    d = spark.createDataFrame(table, "lang STRING, text STRING")
    assert rows(phrases.collocations(d, top=7)) == brute(table, top=7)


def test_edges(edges, spark, tmp_path):
    table = edges.unionByName(edges)
    pairs = [(r.lang, r.text) for r in table.collect()]
    assert rows(phrases.collocations(table, least=2)) == brute(pairs, least=2)
    assert phrases.collocations(edges.limit(0)).count() == 0
    nulls = edges.selectExpr("*", "CAST(NULL AS STRING) AS l").drop("lang").withColumnRenamed("l", "lang")
    assert {r.lang for r in phrases.collocations(nulls).collect()} == {"und"}
    long = [("en", "x y z " * 100_000)]
    spark.createDataFrame(long, "lang STRING, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(phrases.op11_phrases(spark, str(tmp_path))) == brute(long)


def test_scores_past_64_bits(spark):
    table = [("en", "u v " * 100_000)] * 32
    found = brute(table)
    d = spark.createDataFrame(table, "lang STRING, text STRING")
    assert rows(phrases.collocations(d)) == found and 1000000 * found[0][3] ** 2 > 2**63
