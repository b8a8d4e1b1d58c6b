"""Best-fit packing against a search through all open bins, and on awkward tables."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_documents import prose
from wattframe.llm import bestfit, packing


def plain(lengths, window):
    """Every open bin is looked at."""
    room, bins = [], []
    for n in lengths:
        fit = [r for r in room if r >= n]
        if not fit:
            room.append(window)
            fit = [window]
        b = max(i for i, r in enumerate(room) if r == min(fit))
        bins.append(min(fit))
        room[b] -= n
    return bins, sorted(room)


@pytest.mark.parametrize("seed", range(6))
def test_tightest_bin(seed):
    r = random.Random(seed)
    window = r.choice([1, 7, 64, 100])
    lengths = sorted((r.randint(1, window) for _ in range(300)), reverse=True)
    bins, offsets, room = bestfit.best_fit_decreasing(lengths, window)
    fit, left = plain(lengths, window)
    assert [window - o for o in offsets] == fit and sorted(room) == left
    held = Counter()
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        assert held[b] == o
        held[b] += n


def whole(rows, ids=True):
    """Sequences are gapless and within the window; returns each document's ids, by its pieces."""
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    return by


def test_packs_every_document(docs, edges):
    coder = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = [prose(9000, 1), "Straße, ÉCOLE's 12 o'clock <|endoftext|> x", "", None, *(prose(n, n) for n in range(1, 400, 7))]
    for d in (docs(texts), edges, edges.limit(0)):
        rows = bestfit.pack(d).collect()
        by = whole(rows)
        assert all(n <= 4096 for n in by.values())
        want = [[*coder.encode(r.text or "", add_special_tokens=False).ids, bestfit.END] for r in d.collect()]
        cut = [w[k : k + 4096] for w in want for k in range(0, len(w), 4096)]
        assert Counter(tuple(c) for c in cut) == Counter(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
        assert all(r.start == 4096 * r.piece for r in rows)
        # a single group: as best-fit decreasing over the whole table
        assert len(by) == len(plain(sorted(map(len, cut), reverse=True), 4096)[1])


def test_many_groups_pack_as_well(docs):
    r = random.Random(3)
    table = docs([(None if i % 3 == 0 else i, prose(r.choice([3, 5, 9, 14, 22]), i), "s") for i in range(600)])
    rows = bestfit.pack(table, window=64, group_tokens=1500, group_rows=200).collect()
    by = whole(rows)
    need = -(-sum(x.length for x in rows) // 64)
    assert len(rows) == 600 and len(by) <= 1.05 * need + 1 and max(by.values()) <= 64


def test_special_tokens_and_query(spark, docs, tmp_path):
    docs(["hello <|endoftext|> there", "x"]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in bestfit.op12_best_fit(spark, str(tmp_path)).collect()}
    assert rows[0].ids_crc32 == zlib.crc32(np.array([3306, 49407, 997, 1], "<u4").tobytes()) and rows[0].length == 4
    assert len({r.sequence_id for r in rows.values()}) == 1
