"""Spelling variants against all pairs of words, and on awkward tables."""

import random
import re
import zlib
from collections import Counter

import pytest

from wattframe.llm import variants


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a != b and (a[k + 1 :] == b[k:] if len(a) == len(b) + 1 else len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.mark.parametrize("letters, most", [("ab", 7), ("abcdé", 5), ("a", 12)])
def test_pairs_of_the_composition(letters, most):
    r = random.Random(most)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(150)})
    got = [tuple(sorted(p)) for p in variants.OneEdit(words).pairs()]
    want = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)]
    assert sorted(got) == sorted(want)


def test_acceptor_is_minimal():
    words = sorted(p + s for p in ("ab", "cd", "ef") for s in ("ing", "ings", "ed"))
    a = variants.Acceptor(words)

    def follows(state):
        return ([""] if a.final[state] else []) + [c + s for c, t in a.next[state].items() for s in follows(t)]

    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += a.next[s].values()
    assert sorted(follows(0)) == words
    assert len({tuple(sorted(follows(s))) for s in reached}) == len(reached)


@pytest.mark.parametrize("partition, task", [(2000, 20000), (1, 3), (10, 40)])
def test_partitions(spark, partition, task):
    r = random.Random(partition)
    words = {"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(250)} | {"common" + "".join(r.choice("xy") for _ in range(4)) for _ in range(12)}
    n = {w: r.randint(3, 60) for w in sorted(words)}
    v = spark.createDataFrame(sorted(n.items()), "word STRING, n BIGINT")
    assert rows(variants.group(v, partition=partition, task=task)) == brute(n)


def vocabulary(table):
    n = Counter()
    for r in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def test_whole_texts(docs, edges, spark, tmp_path):
    r = random.Random(5)
    stems = ["Straße", "ÉCOLE", "colour", "color", "running", "runing", "abcde"]
    texts = [" ".join(r.choice(stems) + r.choice(["", "s", "7", "-"]) for _ in range(300)) for _ in range(40)]
    long = "ab" * 15000
    table = docs([*texts, "A" * 30000, "wordy " * 20000, " ".join([long] * 7), " ".join([long + "x"] * 3), " ".join(["c" + long[1:]] * 3)])
    assert rows(variants.variants(table)) == brute(vocabulary(table.collect()))
    many = edges.unionByName(edges).unionByName(edges)
    assert rows(variants.variants(many)) == brute(vocabulary(many.collect()))
    assert variants.variants(edges.limit(0)).count() == 0
    table.write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(variants.op13_variants(spark, str(tmp_path))) == rows(variants.variants(table))


def test_on_the_documents(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    assert rows(variants.op13_variants(spark, small_dir)) == brute(vocabulary(table))
