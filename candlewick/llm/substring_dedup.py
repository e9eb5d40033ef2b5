"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last ``REACH`` bytes proposes cuts; one that follows
another by less than ``SHORTEST`` bytes is passed over. Both rules look at a few
bytes around a place only, so equal passages are cut alike wherever they stand
and an insertion shifts nothing beyond its own chunk (about 30 bytes on average).
Texts of few distinct words have proposals too dense or none: a chunk of over
``WIDE`` bytes is cut at the least of a second hash in the next ``WINDOW`` bytes, so
that cuts in equal passages soon fall together, whatever stands before them.
Chunks are compared by 64-bit digest. The first place of a chunk, by (document,
position), is kept; later ones are marked, and touching marked chunks are runs. A
run's ends lie in chunks that the passage shares with other text, so each end is
moved out as far as the bytes are those around its first place, at most one
chunk. Runs of ``MIN_WORDS`` whole words or more are then taken out. Shorter ones
stay, as common phrases repeat by chance. Runs of under ``SEED`` bytes are not
looked at: their passage has hardly so many words.

A document is an id and a text: rows equal in both count as one, so repeated rows
stay and keep the same text; rows that share an id only are ordered by a hash of
their text; a null id is the first. Null and empty texts stay as they are. Ties cannot occur, as a
place holds one chunk. Long texts are cut whole, with no bound on their chunks.
Further columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

REACH = 8
#: A place in so many is proposed as a cut.
RATE = 16
SHORTEST = 12
#: A chunk of more bytes is cut again, at a place up to ``WINDOW`` bytes from its start.
WIDE = 64
WINDOW = 48
#: No chunk is longer, whatever the text.
LONGEST = 1024
MIN_WORDS = 25
SEED = 48
SPACES = b" \t\n\v\f\r"


def _gear() -> np.ndarray:
    """A random-looking 32-bit number for each byte, from a fixed rule."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=0x6EA5) for b in range(256)], np.uint32)


GEAR = _gear()


def cuts(text: bytes) -> np.ndarray:
    """Where chunks end, the end of the text included."""
    b = np.frombuffer(text, np.uint8)
    h = GEAR[b]
    width = 1
    while width < REACH:  # the hash of twice as many bytes, from two of half as many
        g = h.copy()
        g[width:] += h[:-width] << np.uint32(width) if len(h) > width else np.uint32(0)
        h = g
        width *= 2
    # The low bits see the whole reach only from bit REACH - 1 on: take them above it.
    ends = np.flatnonzero((h >> np.uint32(REACH - 1)) % np.uint32(RATE) == 0) + 1
    ends = ends[np.diff(ends, prepend=-SHORTEST) >= SHORTEST]
    ends = np.append(ends[ends < len(b)], len(b))
    gaps = np.diff(ends, prepend=0)
    if len(gaps) and gaps.max() > WIDE:
        g = h.copy()
        g[REACH:] += h[:-REACH] << np.uint32(REACH)
        g = (g >> np.uint32(2 * REACH - 1)) * np.uint32(0x9E3779B1)
        out, at = [], 0
        for e in ends.tolist():
            while e - at > WIDE:  # the last of equal least ones: the same step through text of one period
                at += WINDOW - int(g[at + SHORTEST - 1 : at + WINDOW][::-1].argmin())
                out.append(at)
            out.append(e)
            at = e
        ends = np.array(out)
    return ends


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: ``key``, ``th`` (Spark's hash of the text), first and end byte, digest."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            at, start, end, h = [], [], [], []
            for k, t in enumerate(batch.column(2)):
                t = t.as_py()
                if not t:
                    continue
                e = cuts(t).tolist()
                s = [0, *e[:-1]]
                at += [k] * len(e)
                start += s
                end += e
                h += [digest(t[x:y]) for x, y in zip(s, e)]
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))],
                ["key", "th", "start", "end", "h"],
            )

    return rows.mapInArrow(run, f"key {kind}, th long, start int, end int, h long")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks that an earlier place holds as well: ``key, th, start, end`` and that place, ``k1, t1, s1``.

    Digests are counted by an aggregation that combines before it shuffles. The
    joins back are ones that Spark may split where a chunk is hot, as each digest
    has one row on the other side.
    """
    c = chunks(docs, key, text)
    twice = written(c.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "twice")
    places = written(c.join(twice, "h").select("h", "key", "th", "start", "end"), "places")
    firsts = places.groupBy("h").agg(F.min(F.struct("key", "th", "start")).alias("first"))
    # Written, so that the join has an exchange of its own, which Spark may split, and not the aggregation's.
    firsts = written(firsts.select("h", F.col("first.key").alias("k1"), F.col("first.th").alias("t1"), F.col("first.start").alias("s1")), "firsts")
    later = ~(F.col("key").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("t1")) & (F.col("start") == F.col("s1")))
    return places.join(firsts, "h").where(later).select("key", "th", "start", "end", "k1", "t1", "s1")


def edges(found: DataFrame) -> DataFrame:
    """Both ends of each run of touching chunks of ``SEED`` bytes or more.

    ``key, th, a, b`` (the run), ``right`` (which end), and where the bytes beyond
    it are to be looked up: before (left) or from (right) byte ``at`` of ``k1, t1``.
    """
    # A document's chunks: bounded by its text.
    per = found.groupBy("key", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end", "k1", "t1", "s1"))).alias("found"))
    schema = found.schema
    key = schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            of, a, b, right, first, k1, t1, at = [], [], [], [], [], [], [], []
            lists = batch.column(2)
            flat = lists.flatten()
            start, end, s1 = (np.asarray(flat.field(k), np.int64) for k in (0, 1, 4))
            ends = np.cumsum(np.asarray(lists.value_lengths(), np.int64))
            for row, stop in enumerate(ends.tolist()):
                low = int(ends[row - 1]) if row else 0
                cut = np.flatnonzero(start[low + 1 : stop] != end[low : stop - 1]) + low + 1
                for x, y in zip([low, *cut.tolist()], [*cut.tolist(), stop]):
                    if end[y - 1] - start[x] >= SEED:
                        of += [row, row]
                        a += [start[x]] * 2
                        b += [end[y - 1]] * 2
                        right += [False, True]
                        first += [x, y - 1]
                        at += [s1[x], s1[y - 1] + end[y - 1] - start[y - 1]]
            of, first = pa.array(of, pa.int64()), pa.array(first, pa.int64())
            ints = [pa.array(np.array(x, np.int64)).cast(pa.int32()) for x in (a, b, at)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), ints[0], ints[1], pa.array(right, pa.bool_()), flat.field(2).take(first), flat.field(3).take(first), ints[2]],
                ["key", "th", "a", "b", "right", "k1", "t1", "at"],
            )

    return per.mapInArrow(run, f"key {key}, th long, a int, b int, right boolean, k1 {key}, t1 long, at int")


def contexts(docs: DataFrame, ends: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k1, t1, at, right, bytes``: what stands before or from each place asked for, ``WIDE`` bytes at most."""
    # The places of one document: at most two for each of its chunks.
    asked = ends.select("k1", "t1", "at", "right").distinct().groupBy("k1", "t1").agg(F.collect_list(F.struct("at", "right")).alias("asked"))
    asked = written(asked, "asked")
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(asked, F.col("key").eqNullSafe(F.col("k1")) & (F.col("th") == F.col("t1"))).select("k1", "t1", "text", "asked")
    kind = ends.schema["k1"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            of, at, right, out = [], [], [], []
            for k, (t, places) in enumerate(zip(batch.column(2), batch.column(3))):
                t, places = t.as_py(), places.as_py()
                of += [k] * len(places)
                at += [x["at"] for x in places]
                right += [x["right"] for x in places]
                out += [t[x["at"] : x["at"] + WIDE] if x["right"] else t[max(0, x["at"] - WIDE) : x["at"]] for x in places]
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(right, pa.bool_()), pa.array(out, pa.binary())], ["k1", "t1", "at", "right", "bytes"])

    # Repeated rows give a place more than once.
    return rows.mapInArrow(run, f"k1 {kind}, t1 long, at int, right boolean, bytes binary").groupBy("k1", "t1", "at", "right").agg(F.first("bytes").alias("bytes"))


def runs_of(text: bytes, found: list[tuple[int, int, bytes, bytes]], min_words: int) -> list[tuple[int, int]]:
    """Runs ``(a, b)`` moved out by the bytes that stood before and after their first places, joined where they
    meet, drawn in to whole words; those with enough words."""
    out: list[list[int]] = []
    for a, b, before, after in sorted(found):
        n = 0
        while n < len(before) and n < a and text[a - 1 - n] == before[-1 - n]:
            n += 1
        a -= n
        n, most = 0, min(len(after), len(text) - b)
        while n < most and text[b + n] == after[n]:
            n += 1
        b += n
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    runs = []
    for a, b in out:
        while 0 < a < b and text[a - 1] not in SPACES:
            a += 1
        while a < b < len(text) and text[b - 1] not in SPACES and text[b] not in SPACES:
            b -= 1
        if len(text[a:b].split()) >= min_words:
            runs.append((a, b))
    return runs


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """``text`` without its runs; a line break inside a run is kept as one."""
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
        if a and text[a - 1 : a] != b"\n" and b"\n" in text[a:b]:
            out.append(b"\n")
    out.append(text[at:])
    return b"".join(out)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with their columns, texts without later repeats, and ``__spans`` (bytes taken out of the old text)."""
    columns = docs.columns
    ends = written(edges(repeats(docs, key, text)), "edges")
    around = written(contexts(docs, ends, key, text), "contexts")
    same = F.col("k1").eqNullSafe(F.col("k2")) & (F.col("t1") == F.col("t2")) & (F.col("at") == F.col("at2")) & (F.col("right") == F.col("right2"))
    known = ends.join(around.toDF("k2", "t2", "at2", "right2", "bytes"), same).select("key", "th", F.struct("a", "b", "right", "bytes").alias("end"))
    # All runs of one document: bounded by its text.
    per = written(known.groupBy(F.col("key").alias("__key"), F.col("th").alias("__th")).agg(F.collect_set("end").alias("__found")), "repeats")
    joined = docs.join(per, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.xxhash64(docs[f"`{text}`"]) == F.col("__th")), "left")
    joined = joined.select(*[docs[f"`{c}`"] for c in columns], "__found")
    at = columns.index(text)
    schema = joined.select(*[joined[f"`{c}`"] for c in columns], F.expr("CAST(null AS array<struct<start:int,end:int>>) AS __spans")).schema
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for t, f in zip(batch.column(at).cast(pa.binary()), batch.column(len(columns))):
                t, f = t.as_py(), f.as_py()
                by: dict = {}
                for x in f or ():
                    by.setdefault((x["a"], x["b"]), {})[x["right"]] = x["bytes"]
                runs = runs_of(t, [(*r, x.get(False, b""), x.get(True, b"")) for r, x in by.items()], min_words) if by else []
                texts.append(without(t, runs) if runs else t)
                spans.append([{"start": a, "end": b} for a, b in runs])
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            arrays[-1] = pa.array(spans, span)
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "__spans"])

    return joined.mapInArrow(run, schema)
