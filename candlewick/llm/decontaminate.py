"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are lower-cased runs (A-Z only) of letters, digits and all characters
beyond ASCII. A window is ten consecutive words of an item; an item with fewer
words, but not none, is one window. All windows of one length form one pattern
set: a shift table over two-word blocks says how far the search may jump, the
windows that end in a block form its bucket, where a hash picks the ones to look
at, and a direct comparison confirms each occurrence.

Patterns are places in one array of word numbers, and the tables are sorted
arrays beside it: some 30 bytes a window, besides the words themselves. A Python
worker keeps the tables of the last few blocks of items from task to task.

Nulls, empty texts and texts without words: no words, no hits. Items without
words match nothing; repeated items each count; an item with a null id is
searched, so its words count as hit, but cannot be listed. Repeated document
rows are judged one by one. Long texts are searched whole. Only the named columns
are read, so further columns cannot clash.

The benchmark is a stated query set. Its size is measured first; items are
searched in blocks of at most ``block_bytes`` of text, one pass over the
documents per block, and the hits of several blocks are merged by key.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 10
#: Text of the items that one pass holds in each Python worker's memory at most.
BLOCK_BYTES = 16 << 20
#: The longest step: shifts are kept in one byte.
FAR = 255
#: Blocks whose shift a searcher remembers; beyond it the memory starts anew.
REMEMBERED = 100_000
#: Blocks whose tables a worker keeps.
KEPT_BLOCKS = 2

#: A-Z to a-z; every other ASCII byte that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(columns: Iterable[np.ndarray]) -> np.ndarray:
    """A 40-bit hash of windows, given as their first words, their second ones and so on."""
    h = np.uint64(0)
    for c in columns:
        h = (c.astype(np.uint64) + h) * _FACTOR
        h ^= h >> np.uint64(29)
    return h >> np.uint64(24)


class WuManber:
    """All windows of one length, given by their starts in an array of word numbers from 1 on."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray):
        self.length, self.words = length, words
        self.block = min(2, length)
        every = words.astype(np.uint64)
        if self.block == 2:
            every = (every[:-1] << np.uint64(32)) | every[1:]
        #: A block's least distance to a window's end, by sorted block.
        blocks, distance = [], []
        for d in range(length - self.block + 1):  # nearly all blocks end a window: few are new at a distance
            found = np.unique(every[starts + length - self.block - d])
            for had in blocks:
                found = found[~np.isin(found, had, assume_unique=True)]
            blocks.append(found)
            distance.append(np.full(len(found), min(d, FAR), np.uint8))
        key, distance = np.concatenate(blocks), np.concatenate(distance)
        order = np.argsort(key)
        self.keys, self.shift = key[order], distance[order]
        self.known: dict[int, int] = {}
        #: Windows by bucket, the number of their last block, and hash in it.
        bucket = np.searchsorted(self.keys, every[starts + length - self.block]).astype(np.uint64)
        place = (bucket << np.uint64(40)) | _hashes(words[starts + k] for k in range(length))
        order = np.argsort(place, kind="stable")
        self.place, self.starts = place[order], starts[order]

    def _step(self, block: int) -> int:
        """How far the search may go on from a block; 0: a window may end here."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        at = int(np.searchsorted(self.keys, np.uint64(block)))
        there = at < len(self.keys) and int(self.keys[at]) == block
        step = self.known[block] = int(self.shift[at]) if there else self.length - self.block + 1
        return step

    def search(self, words: list[bytes], number) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the occurrences, from left to right, and where each window stands in the items.

        ``number`` gives a word's number, or its second argument. Words are numbered only where the search comes by.
        """
        n, pair, step_of = self.length, self.block == 2, self.known.get
        starts, windows, last, total = [], [], n - 1, len(words)
        while last < total:
            block = number(words[last])
            if block is None:  # no window holds this word
                last += n
                continue
            if pair:
                before = number(words[last - 1])
                if before is None:
                    last += n - 1
                    continue
                block |= before << 32
            step = step_of(block)
            if step is None:
                step = self._step(block)
            if step:
                last += step
            else:
                last += 1
                window = [number(w, 0) for w in words[last - n : last]]
                if 0 not in window:
                    starts.append(last - n)
                    windows.append(window)
        none = np.zeros(0, np.int64)
        if not starts:
            return none, none
        start, own = np.array(starts), np.array(windows, np.uint32)
        block = own[:, -1].astype(np.uint64)
        if pair:
            block |= own[:, -2].astype(np.uint64) << np.uint64(32)
        place = (np.searchsorted(self.keys, block).astype(np.uint64) << np.uint64(40)) | _hashes(own.T)
        low, high = np.searchsorted(self.place, place, "left"), np.searchsorted(self.place, place, "right")
        count = high - low
        if not count.any():
            return none, none
        first = np.cumsum(count) - count
        found = self.starts[np.repeat(low - first, count) + np.arange(count.sum())]
        same = (np.repeat(own, count, axis=0) == self.words[found[:, None] + np.arange(n)]).all(axis=1)
        return np.repeat(start, count)[same], found[same]


class Items:
    """The items of one block: their words as numbers, and a searcher for each length of windows."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        number = self.number.setdefault
        self.names, first, words = [], [], array("I")
        by_length: dict[int, array] = {}
        for item, text in items:
            own = [number(w, len(self.number) + 1) for w in words_of(text)]
            if own:
                n = min(window, len(own))
                by_length.setdefault(n, array("q")).extend(range(len(words), len(words) + len(own) - n + 1))
                self.names.append(item)
                first.append(len(words))
                words.extend(own)
        self.first = np.array(first, np.int64)
        text = np.array(words, np.uint32)
        self.searchers = [WuManber(n, text, np.array(starts, np.int64)) for n, starts in by_length.items()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint, sorted word ranges that occurrences cover, and the items with an id that occur."""
        spans, items = [], set()
        for s in self.searchers:
            start, found = s.search(words, self.number.get)
            if len(start):
                spans += [(x, x + s.length) for x in np.unique(start).tolist()]
                items.update(self.names[k] for k in np.unique(np.searchsorted(self.first, found, "right") - 1).tolist())
        return joined(spans), items - {None}


#: Tables of the blocks that this Python worker searched last.
_ITEMS: dict[str, Items] = {}


def _items(block, window: int) -> Items:
    """Of a broadcast ``(name, items)``; compiled once a worker."""
    name, items = block.value
    if (found := _ITEMS.get(name)) is None:
        while len(_ITEMS) >= KEPT_BLOCKS:
            _ITEMS.pop(next(iter(_ITEMS)))
        found = _ITEMS[name] = Items(items, window)
    return found


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(items: Iterable) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list]:
    """The items in driver-sized blocks: as many as their measured bytes ask for."""
    b = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL")
    measured = b.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    k = 1 + 2 * measured // block_bytes if measured > block_bytes else 1
    for at in range(k):
        part = b if k == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == at)
        yield [(r["i"], r["t"].encode()) for r in part.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: words, hit words, hit ranges and the items that occur in it.

    Columns: ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated``, ``spans`` (word ranges, end excluded) and ``items``.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("th"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, th long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<start:int,end:int>>, items array<string>"
    blocks = [spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in _blocks(benchmark, item, item_text, block_bytes)]

    def searched(block) -> DataFrame:
        def run(batches):
            find = _items(block, window).find
            for batch in batches:
                out = []
                for t in batch.column(1):
                    words = words_of(t.as_py())
                    spans, items = find(words)
                    out.append((len(words), sum(b - a for a, b in spans), len(items), _digest(items), [{"start": a, "end": b} for a, b in spans], sorted(map(str, items))))
                n, hit, k, digest, spans, items = zip(*out) if out else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(k, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    ["key", "th", "n_words", "n_hit", "n_items", "items_sha256", "spans", "items"],
                )

        return rows.mapInArrow(run, schema)

    if len(blocks) == 1:
        found = searched(blocks[0])
    else:
        found = _merged(rows, searched, blocks)
    return found.select(F.col("key").alias(key), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans", "items")


def _merged(rows: DataFrame, searched, blocks) -> DataFrame:
    """Several passes: the few hit rows of each are merged and joined to the first pass.

    Rows of one key with different texts are told apart by the text's hash.
    """
    first = written(searched(blocks[0]), "scan")
    hits = [first.where("n_hit > 0")] + [searched(b).where("n_hit > 0") for b in blocks[1:]]
    union = hits[0]
    for h in hits[1:]:
        union = union.unionByName(h)

    def flat(name: str):
        return F.flatten(F.collect_set(name))

    merged = union.groupBy("key", "th").agg(F.array_sort(flat("spans")).alias("s"), F.array_sort(F.array_distinct(flat("items"))).alias("i"))
    step = "struct<start:int,end:int>"
    merged = merged.select(
        F.col("key").alias("k2"),
        F.col("th").alias("t2"),
        F.expr(
            f"""aggregate(s, CAST(array() AS array<{step}>), (a, x) -> CASE
                WHEN size(a) > 0 AND element_at(a, -1).end >= x.start
                THEN concat(slice(a, 1, size(a) - 1), array(CAST(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)) AS {step})))
                ELSE concat(a, array(x)) END)"""
        ).alias("s2"),
        F.col("i").alias("i2"),
    )
    j = first.join(merged, F.col("key").eqNullSafe(F.col("k2")) & (F.col("th") == F.col("t2")), "left")
    hit = F.col("t2").isNotNull()
    return j.select(
        "key",
        "n_words",
        F.when(hit, F.expr("aggregate(s2, 0L, (a, x) -> a + x.end - x.start)")).otherwise(F.col("n_hit")).alias("n_hit"),
        F.when(hit, F.size("i2").cast("long")).otherwise(F.col("n_items")).alias("n_items"),
        F.when(hit, F.sha2(F.array_join("i2", ","), 256)).otherwise(F.col("items_sha256")).alias("items_sha256"),
        F.when(hit, F.col("s2")).otherwise(F.col("spans")).alias("spans"),
        F.when(hit, F.col("i2")).otherwise(F.col("items")).alias("items"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any occurrence, with all their columns unchanged."""
    spark, columns = docs.sparkSession, docs.columns
    blocks = [spark.sparkContext.broadcast((uuid.uuid4().hex, b)) for b in _blocks(benchmark, "item_id", "text", block_bytes)]
    at = columns.index(text)
    for block in blocks:

        def run(batches, block=block):
            find = _items(block, WINDOW).find
            for batch in batches:
                keep = [not find(words_of(t.as_py()))[0] for t in batch.column(at).cast(pa.binary())]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL of ``scan`` over ``documents`` and ``benchmark``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
b AS (SELECT item_id, {words} AS ws FROM benchmark),
p AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT item_id, ws, least({window}, len(ws)) AS n, unnest(range(1, len(ws) - least({window}, len(ws)) + 2)) AS i
    FROM b WHERE len(ws) > 0)),
o AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (
    SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
h AS (SELECT rid, item_id, i, n FROM o JOIN p USING (n, g)),
hw AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS w FROM h) GROUP BY rid),
hi AS (SELECT rid, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""
