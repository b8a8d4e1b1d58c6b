"""Pack token streams into fixed windows: concatenate and cut.

Documents are tokenised once. Each task sums its own tokens; a running sum over the
task totals (one number per task) turns places in a task into places in the whole
stream, and the stream is cut every ``window`` tokens.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import map_batches

TOKENIZER = "word_bpe_49k.json"
END = 2
WINDOW = 4096
#: Words, and pieces of words, whose ids a worker remembers; each memory is emptied when it is full.
REMEMBERED = 500_000
#: Bytes of ids in one row of output batches.
_CHUNK = 4 << 20
#: Words of Latin letters, digits and ASCII signs (no apostrophe), and what the tokenizer splits them into.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordTokens:
    """Ids of texts, by way of their blank-separated words.

    The tokenizer never joins across white space, so a text's ids are those of its
    words in order. Its normaliser changes plain words in case only, and its splitting
    rule cuts them where letters, single digits and other characters meet; so their
    pieces go to the vocabulary's model directly, many at once and each once, and an id
    that closes a piece shows where it ends. Other words take the whole tokenizer.
    With ``special``, special tokens that a text spells out have their own ids, as the
    tokenizer file says; without, they are plain characters.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        plain: dict[str, list[str]] = {}
        for w in words:
            if _PLAIN.fullmatch(w) and "<|" not in w:
                plain[w] = _PIECE.findall(w.lower())
            else:
                self.known[w] = self._one(w)
        parts = self.parts
        new = [p for p in dict.fromkeys(chain.from_iterable(plain.values())) if p not in parts]
        if new:
            (found,) = self.model.encode_batch_fast([" ".join(new)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            parts.update((p, raw[a:b]) for p, a, b in zip(new, [0, *ends[:-1]], ends, strict=True))
        self.known.update((w, b"".join([parts[p] for p in ps])) for w, ps in plain.items())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        words = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            new = [w for w in dict.fromkeys(words) if w not in known]
            for k in range(0, len(new), 5000):
                self.learn(new[k : k + 5000])
        return b"".join(map(known.__getitem__, words))


#: The coder of this worker process and what it was made for; tasks that follow find its words.
_CODER: dict[tuple[str, bool], WordTokens] = {}


def coder(path: str, special: bool) -> WordTokens:
    if (path, special) not in _CODER:
        _CODER.clear()
        _CODER[path, special] = WordTokens(path, special)
    return _CODER[path, special]


def tokenise(docs: DataFrame, path: str, special: bool = False, end_id: int = END) -> DataFrame:
    """``doc_id, part, start, tokens, ids``: ``start`` counts the tokens before it in its task; ``end_id`` closes each document."""

    def run(batch, state={}):  # noqa: B006  one state per task's worker process
        task = TaskContext.get().partitionId()
        key = (TaskContext.get().stageId(), TaskContext.get().taskAttemptId())
        if state.get("key") != key:
            state |= {"key": key, "at": 0}
        encode = coder(path, special).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        out: dict[str, list] = {"doc_id": [], "part": [], "start": [], "tokens": [], "ids": []}
        held = 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = encode(text or "") + end
            n = len(ids) // 4
            for k, v in (("doc_id", doc_id), ("part", task), ("start", state["at"]), ("tokens", n), ("ids", np.frombuffer(ids, "<u4").astype("<u2").tobytes())):
                out[k].append(v)
            state["at"] += n
            held += len(ids)
            if held > _CHUNK:
                yield out
                out, held = {k: [] for k in out}, 0
        if out["doc_id"]:
            yield out

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id BIGINT, part INT, start BIGINT, tokens BIGINT, ids BINARY")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, ids: bool = True, special: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, its ``ids``.

    Every sequence but the last holds ``window`` tokens, so only the last is padded.
    A document that crosses a border gives one piece on each side.

    * A null or empty text gives the end id alone.
    * Special tokens spelled out in a text are plain characters unless ``special`` is set;
      the queries set it, so their ids are those of the tokenizer file as it is.
    * A null ``doc_id`` and repeated rows are ordinary documents.
    * An empty table gives no pieces. Other columns are not read.
    """
    t = materialise(tokenise(docs, path or public_tokenizers.path(TOKENIZER), special), "tokens")
    # one row per task that wrote tokens
    totals = t.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = t.join(F.broadcast(bases), "part")  # two numbers per task

    def cut(batch):
        out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        held = 0
        cols = [batch.column(k).to_pylist() for k in ("doc_id", "start", "base", "tokens")]
        for doc_id, start, base, n, raw in zip(*cols, batch.column("ids"), strict=True):
            at, tokens, done = start + base, np.frombuffer(raw.as_py(), "<u2").astype("<u4"), 0
            while done < n:
                take = min(n - done, window - (at + done) % window)
                piece = tokens[done : done + take].tobytes()
                row = (doc_id, done, take, zlib.crc32(piece), n, (at + done) // window, (at + done) % window, piece if ids else None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
                done += take
                held += len(piece) if ids else 64
            if held > _CHUNK:
                yield out
                out, held = {k: [] for k in out}, 0
        if out["doc_id"]:
            yield out

    schema = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT, ids BINARY"
    pieces = map_batches(placed, cut, schema)
    return pieces if ids else pieces.drop("ids")


def op6_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False, special=True)
