"""Packing by minimum bin slack.

A document's ids, closed by the end id, are cut into pieces of one whole window
and a rest. Whole pieces are sequences of their own. Rests meet as a histogram
of lengths, which a window's length bounds. For each window the longest length
left is set, and a bitset holds which sums the others can reach; the sum closest
to the capacity is traced back to counts of each length. The multiset found is
applied as often as the histogram allows, so that a plan has a few thousand
steps however many rows there are. Rows take their places by rank in their
length, which is counted apart in each file of the written pieces: a hot length is
as many tasks as there are files, and their number grows with the table.

Null and empty texts hold the end id alone. Repeated rows are packed each. Long
texts are tokenized whole. A table without rows gives no sequence. Only the named
columns are read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 2048
END_ID = 1
#: Chunks that a worker remembers, twice: beyond it those not met since the last time are forgotten.
REMEMBERED = 250_000


def _byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


class _Known(dict):
    """Ids by chunk; one that is missing is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(chunk)


class ChunkTokenizer:
    """Ids of texts, by chunks between blanks, tabs and line ends.

    The vocabulary drops white space and no token spans it, so a text's ids are
    those of its chunks one after another. It folds case, and splits a letter
    from a full stop or comma after it, so a capitalised word or one before such
    a mark takes its ids from the plain word. Each plain word is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.merge = self.of.model.tokenize
        self.known = _Known(self._learn)
        self.older: dict[str, bytes] = {}
        self.marks = {"": b"", **{c: self._encoded(c) for c in ".,"}}
        self.known.update(self.marks)

    def _encoded(self, c: str) -> bytes:
        return array("I", self.of.encode(c, add_special_tokens=False).ids).tobytes()

    def _learn(self, c: str) -> bytes:
        known, older = self.known, self.older
        if len(known) > REMEMBERED:
            self.older = older = dict(known)
            known.clear()
            known.update(self.marks)
        if (ids := older.get(c)) is not None:
            known[c] = ids
            return ids
        mark = c[-1] if c[-1] in ".," else ""
        word = c[:-1] if mark else c
        low = word.lower()
        # Beyond Latin letters, folding may depend on neighbours; some letters fold to several characters, and a mark may be the last.
        if not word or len(low) != len(word) or not low[-1].isalpha() or not (word.isascii() or max(word) < "\u0250"):
            known[c] = ids = self._encoded(c)
            return ids
        word = low
        if (ids := known.get(word)) is None and (ids := older.get(word)) is None:
            if word.isalpha() and word == word.lower():
                # One run of letters that no normalization changes: the model's input is its bytes.
                own = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids = array("I", [t.id for t in self.merge(own)]).tobytes()
            else:
                ids = self._encoded(word)
        known[word] = ids
        if word != c:
            known[c] = ids = ids + known[mark]
        return ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Unsigned 32-bit ids of each text."""
        known = self.known
        for text in texts:
            chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            yield b"".join([known[c] for c in chunks])


#: Each worker process keeps its tokenizers, and what they know, from task to task.
_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer_at(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` of each piece."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tok = tokenizer_at(tokenizer)
        for batch in batches:
            at, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(tok.ids(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    at.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *longs], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    return rows.mapInArrow(run, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Step:
    """``times`` windows, each of the lengths with their counts."""

    times: int
    lengths: tuple[tuple[int, int], ...]


def fill(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of ``counts`` whose sum comes closest to ``room`` from below.

    ``order``: the lengths, longest first. Stops once the room is filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach, before = 1, []
    for length in order:
        left = min(counts[length], room // length) if length <= room else 0
        if not left:
            continue
        before.append((length, reach))
        unit = 1
        while left:
            n = min(unit, left)
            reach |= (reach << (n * length)) & mask
            left -= n
            unit *= 2
        if reach >> room & 1:
            break
    target, found = reach.bit_length() - 1, {}
    for length, had in reversed(before):
        n = 0
        while not had >> target & 1:
            target -= length
            n += 1
        if n:
            found[length] = n
    return found


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    counts = {k: n for k, n in histogram.items() if n > 0}
    order = sorted(counts, reverse=True)
    steps = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        found = fill(counts, order, capacity - longest)
        counts[longest] += 1
        found[longest] = found.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in found.items())
        for k, n in found.items():
            counts[k] -= n * times
        steps.append(Step(times, tuple(sorted(found.items(), reverse=True))))
        order = [k for k in order if counts[k]]
    return steps


def _places(steps: list[Step], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts (length, rank packed) of runs of pieces, and each run's first sequence, pieces a window and offset."""
    used: dict[int, int] = {}
    runs, base = [], 0
    for step in steps:
        offset = 0
        for length, n in step.lengths:
            at = used.get(length, 0)
            runs.append(((length << 44) + at, base, n, offset, at, length))
            used[length] = at + n * step.times
            offset += n * length
        base += step.times
    runs.append((capacity << 44, base, 1, 0, 0, capacity))
    runs.sort()
    a = np.array(runs, np.int64)
    return a[:, 0], a[:, 1:]


def packed(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a written table of ``pieces``) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    rows = cut.select(F.col(key).alias("key"), *names[1:], F.xxhash64(F.col("_metadata.file_path")).alias("file"))
    # At most ``capacity`` rows a file, summed before they are dealt; then the few files of a length in order.
    sizes = rows.groupBy("length", "file").agg(F.count("*").alias("n"))
    firsts = written(sizes.selectExpr("length", "file", "n", "sum(n) OVER (PARTITION BY length ORDER BY file) - n AS first"), "ranks")
    histogram = {r["length"]: r["n"] for r in firsts.where(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(_places(planned(histogram, capacity), capacity))
    rank = F.expr("row_number() OVER (PARTITION BY length, file ORDER BY key, start, ids_crc32, doc_tokens)")
    # Dealt by the window's keys, unless the planner sees that the ranks are few enough to broadcast.
    ranked = rows.withColumn("rank", rank).join(firsts.drop("n"), ["length", "file"]).withColumn("rank", F.col("rank") - 1 + F.col("first"))
    ranked = ranked.select("key", *names[1:], "rank")
    kind = ranked.schema["key"].dataType.simpleString()

    def place(batches):
        starts, runs = plan.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(k), np.int64) for k in (2, 5))
            base, per, offset, at, _ = runs[np.searchsorted(starts, (length << 44) + rank, "right") - 1].T
            nth = rank - at
            arrays = [*batch.columns[:5], pa.array(base + nth // per), pa.array(offset + nth % per * length)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", *names[1:], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("key", key)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places; texts are read and tokenized once."""
    return packed(written(pieces(docs, tokenizer, key, text, capacity), "pieces"), key, capacity)
