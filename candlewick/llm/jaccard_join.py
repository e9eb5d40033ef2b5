"""N-gram Jaccard join: classes of texts whose word 5-grams overlap by 0.8 or more.

Chosen-path join. Equal texts first become one. A text's set is embedded as
``EMBED`` minhash values; value v at place i is the token (i, v), and two sets
share a token as often as their similarity says. A run sends each set down the
tokens that a hash of the path samples, about ``CHILDREN`` per node, so that sets
meet in a bucket if they share a sampled token. Small buckets are compared by
brute force; large ones are split again along another token, ``DEPTH`` times at
most or until a child stays nearly as large, and then dealt out in blocks.

Runs come in two rounds, and what is known to be one component by then is not
compared again. The first settles: few runs, one level, large buckets cut into
blocks that share the bucket's centre, the set closest to its commonest minhash
values; its work is linear. The second is whole: it repeats runs until a pair at
the threshold meets with ``TARGET_RECALL`` (``plan`` derives runs and screen from
the threshold), and looks only at buckets that hold two components or more. There
the largest component is dealt out once and the rest goes to each of its blocks,
so a group of near copies costs what stands beside it, not its square. Before that,
sets leave large buckets that have no link there for certain: grams that no other
set of a large bucket holds are in no intersection, and bound all similarities.

Within a bucket the embeddings pick the sets that may have a partner; the full
5-gram sets of those alone are then fetched and compared exactly. What leaves a
bucket is a spanning forest, never pairs. Exact numbers of links are counted
afterwards, within each component: that step compares all of a component's
distinct sets, in pairs of blocks, and alone grows with a component's square;
``links=False`` and ``firsts`` do without it.

Words are lower-cased runs of letters, digits and all characters beyond ASCII, so
that copies which differ in case, marks or spacing have the same grams. A text of
one to four words is one gram. A null text or one without words has no gram and
links to nothing; equal texts, nulls included, share a class all the same. Repeated rows are copies. Ties: the least
id represents, a null id only where there is no other. Texts are read whole. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .decontaminate import words_of

GRAM = 5
THRESHOLD = 0.8
EMBED = 64
CHILDREN = 2.0
#: Runs of the settling round.
SETTLING = 2
DEPTH = 3
#: Sets, and grams of them, that a block holds; larger buckets are split or dealt as blocks.
BUCKET = 512
BLOCK_GRAMS = 1 << 20
TARGET_RECALL = 0.9999
MOST_RUNS = 200
#: A bucket's children that keep this share of it show that its sets are alike.
ALIKE = 0.5
#: Sets of a large bucket from which its commonest minhash values are read, on average.
VOTERS = 64
#: Words that a worker remembers the hashes of; beyond it the memory starts anew.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Plan:
    """Embedded tokens that two sets must share to be compared, and runs of the whole round."""

    screen: int
    runs: int


def _shared(similarity: float) -> list[float]:
    """Chance of each number of shared tokens of a pair."""
    return [math.comb(EMBED, k) * similarity**k * (1 - similarity) ** (EMBED - k) for k in range(EMBED + 1)]


def expected_recall(similarity: float, plan: Plan, depth: int = DEPTH) -> float:
    """Chance that a pair meets in a leaf and passes the screen, if every bucket down to ``depth`` is split."""
    total = 0.0
    for k, chance in enumerate(_shared(similarity)):
        if k >= plan.screen:
            p = 1.0
            for _ in range(depth):
                p = 1 - (1 - CHILDREN / EMBED * p) ** k
            total += chance * (1 - (1 - p) ** plan.runs)
    return total


def plan(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> Plan:
    """The highest screen that loses a quarter of what may be lost, and the runs that reach the target with it."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies above 0 and up to 1")
    below, screen = 0.0, 0
    for k, chance in enumerate(_shared(threshold)):
        below += chance
        if below > (1 - target) / 4:
            break
        screen = k + 1
    for runs in range(1, MOST_RUNS + 1):
        if expected_recall(threshold, found := Plan(screen, runs)) >= target:
            return found
    raise ValueError(f"{MOST_RUNS} runs do not reach a recall of {target} at a similarity of {threshold}")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = _mix(np.arange(1, EMBED + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = (_PLACES >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = _PLACES.astype(np.uint32)


class Grams:
    """The sorted set of 64-bit gram hashes of a text."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = words_of(text.lower().encode()) if text else []
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = len(h) - GRAM + 1
        if n < 1:
            return h[:0] if not len(h) else _mix(np.array([np.bitwise_xor.reduce(_mix(h + np.arange(len(h), dtype=np.uint64)))]))
        g = np.zeros(n, np.uint64)
        for k in range(GRAM):
            g = g * np.uint64(0x9E3779B97F4A7C15) + _mix(h[k : k + n])
        return np.unique(_mix(g))


def embedded(grams: np.ndarray) -> np.ndarray:
    """The least of each of ``EMBED`` hashes over the grams, 32 bits each."""
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(EMBED, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        x = low[None, at : at + 4096] * _ODD[:, None]
        x ^= x >> np.uint32(15)
        x += high[None, at : at + 4096]
        x *= _ODD[::-1, None]
        x += _ADD[:, None]
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, digest of the text (null: null), number of grams and embedding of each row; ``x``: Spark's hash of the text."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("x"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        grams = Grams()
        for batch in batches:
            digest, n, sketch = [], [], []
            for t in batch.column(1).to_pylist():
                digest.append(None if t is None else xxhash.xxh3_128_digest(t))
                g = grams(t)
                n.append(len(g))
                sketch.append(embedded(g).tobytes() if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(sketch, pa.binary()), batch.column(2)], ["key", "t", "n", "sketch", "x"])

    return rows.mapInArrow(run, f"key {kind}, t binary, n int, sketch binary, x long")


def _chosen(paths: np.ndarray, sketch: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of (path, embedding, places used): row, place and child path of each sampled token."""
    token = _mix(sketch.astype(np.uint64) ^ _PLACES[None, :])
    child = _mix(token ^ paths[:, None])
    bound = np.uint64(int(CHILDREN / EMBED * 2**64))
    free = (used[:, None] >> np.arange(EMBED, dtype=np.uint64)[None, :]) & np.uint64(1) == 0
    row, place = np.nonzero((child < bound) & free)
    return row, place, _mix(child[row, place] + np.uint64(1))


def _embeddings(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, EMBED)


_PATHS = "path long, parent long, used long, grams int, t binary, c long"


def _split_roots(sets: DataFrame, first: int, runs: int) -> DataFrame:
    """First level: every set in each of the runs."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sketch = _embeddings(part.column(1))
                for r in range(first, first + runs):
                    root = _mix(np.full(len(sketch), r + 1, np.uint64))
                    row, place, child = _chosen(root, sketch, np.zeros(len(sketch), np.uint64))
                    yield _paths(child, root[row], np.uint64(1) << place.astype(np.uint64), part, row, (2, 0, 3))

    return sets.select("t", "sketch", "n", "c").mapInArrow(run, _PATHS)


def _split_more(large: DataFrame) -> DataFrame:
    """A further level: rows of ``path, used, grams, t, c, sketch``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                path, used = (np.asarray(part.column(k), np.int64).view(np.uint64) for k in (0, 1))
                row, place, child = _chosen(path, _embeddings(part.column(5)), used)
                yield _paths(child, path[row], used[row] | np.uint64(1) << place.astype(np.uint64), part, row, (2, 3, 4))

    return large.select("path", "used", "grams", "t", "c", "sketch").mapInArrow(run, _PATHS)


def _paths(path: np.ndarray, parent: np.ndarray, used: np.ndarray, of: pa.RecordBatch, row: np.ndarray, columns: tuple[int, int, int]) -> pa.RecordBatch:
    numbers = [pa.array(x.view(np.int64)) for x in (path, parent, used)]
    return pa.RecordBatch.from_arrays([*numbers, *(of.column(k).take(pa.array(row)) for k in columns)], ["path", "parent", "used", "grams", "t", "c"])


def _blocks(n: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(n / BUCKET), F.ceil(grams / BLOCK_GRAMS), F.lit(1)).cast("int")


def _mixed(level: DataFrame) -> DataFrame:
    """``path, n, grams, parent, x, y, blocks`` of buckets with sets of two components or more; ``x, y`` tell equal buckets."""
    sizes = level.groupBy("path").agg(
        F.count("*").alias("n"), F.sum("grams").alias("grams"), F.min("parent").alias("parent"),
        F.bit_xor(F.xxhash64("t")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "t")).alias("y"),
        F.min("c").alias("least"), F.max("c").alias("most"),
    )
    return sizes.where("least != most").drop("least", "most").withColumn("blocks", _blocks(F.col("n"), F.col("grams")))


def _once(buckets: DataFrame) -> DataFrame:
    """Equal buckets are compared once."""
    return buckets.groupBy("x", "y", "n", "grams").agg(F.min("path").alias("path"), F.first("blocks").alias("blocks")).select("path", "n", "blocks")


def _held(level: DataFrame, buckets: DataFrame, label: str) -> DataFrame:
    """The rows of the buckets, with their sizes."""
    return written(level.select("path", "used", "grams", "t", "c").join(buckets, "path"), label)


def _centres(members: DataFrame) -> DataFrame:
    """``path, centre``: of each bucket of ``path, n, t, sketch``, the set that agrees best with its commonest minhash values."""
    voters = members.where(F.pmod(F.xxhash64("path", "t"), F.lit(1 << 40)) < F.lit(float(VOTERS << 40)) / F.col("n"))

    def vote(batches):
        for batch in batches:
            out = []
            for votes in batch.column(1).to_pylist():
                sketch = np.frombuffer(b"".join(votes), np.uint32).reshape(-1, EMBED)
                modal = []
                for k in range(EMBED):
                    value, count = np.unique(sketch[:, k], return_counts=True)
                    modal.append(value[count.argmax()])
                out.append(np.array(modal, np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["path", "modal"])

    # About VOTERS sketches a bucket meet in a list.
    modal = voters.groupBy("path").agg(F.collect_list("sketch").alias("votes")).mapInArrow(vote, "path long, modal binary")

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_embeddings(batch.column(2)) == _embeddings(batch.column(3))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.astype(np.int32))], ["path", "t", "same"])

    rated = members.join(written(modal, "modal"), "path").select("path", "t", "sketch", "modal").mapInArrow(agree, "path long, t binary, same int")
    return rated.groupBy("path").agg(F.max(F.struct("same", "t")).alias("top")).select("path", F.col("top.t").alias("centre"))


def _settling_tasks(sets: DataFrame) -> DataFrame:
    """``task, t, c`` of the settling round: small buckets, and blocks of large ones, each with the bucket's centre."""
    level = _split_roots(sets, 0, SETTLING)
    rows = _held(level, _once(_mixed(level)), "leaves")
    tasks = rows.where("blocks = 1").select(F.col("path").alias("task"), "t", "c")
    large = rows.where("blocks > 1").select("path", "t", "c", "n", "blocks")
    if large.isEmpty():
        return tasks
    members = written(large.select("path", "n", "t").join(sets.select("t", "sketch"), "t"), "members")
    centres = _centres(members.select("path", "n", "t", "sketch"))
    block = F.pmod(F.xxhash64("t", "path"), F.col("blocks")).cast("int")
    dealt = large.select(F.xxhash64("path", block).alias("task"), "t", "c")
    shared = centres.withColumnRenamed("centre", "t").join(large, ["path", "t"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return tasks.unionByName(dealt.unionByName(shared.select(F.xxhash64("path", "block").alias("task"), "t", "c")).distinct())


def _sides(held: DataFrame) -> DataFrame:
    """Adds to rows of large buckets ``c1``, the bucket's largest component, and into how many blocks that and the rest are dealt."""
    parts = held.groupBy("path", "c").agg(F.count("*").alias("m"))
    top = parts.groupBy("path").agg(F.max(F.struct("m", "c")).alias("top"))
    # Written, so that its size is known: the join deals the hot buckets' rows anew only where it cannot broadcast.
    top = written(top.select("path", F.col("top.m").alias("m1"), F.col("top.c").alias("c1")), "top")
    return _shares(held.join(top, "path"))


def _shares(buckets: DataFrame) -> DataFrame:
    """Adds ``nd`` and ``nr``, the blocks of the largest component and of the rest."""
    share = F.col("m1") / F.col("n")
    return buckets.withColumn("nd", F.ceil(F.col("blocks") * share).cast("int")).withColumn("nr", F.greatest(F.ceil(F.col("blocks") * (1 - share)), F.lit(1)).cast("int"))


def _linkable(large: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The rows of large buckets without sets that can have no link there, buckets measured anew.

    ``grams``: the gram sets of all of them. If s of a set's n grams are in another
    set too, a set of m grams reaches the threshold with it only if
    s >= threshold * (n + m - s); and m is at least threshold * n, and the least in the bucket.
    """

    def opened(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.frombuffer(g, np.int64) for g in part.column(1).to_pylist()]
                of = np.repeat(np.asarray(part.column(0), np.int64), [len(g) for g in sets])
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(sets))], ["of", "gram"])

    held = grams.join(large.select("t").distinct(), "t", "left_semi").select(F.xxhash64("t").alias("of"), "grams")
    alone = held.mapInArrow(opened, "of long, gram long").groupBy("gram").agg(F.count("*").alias("m"), F.min("of").alias("of")).where("m = 1")
    alone = written(alone.groupBy("of").agg(F.count("*").alias("alone")), "alone")
    shared = F.col("grams") - F.coalesce("alone", F.lit(0))
    rows = large.drop("n", "blocks").join(alone, F.xxhash64("t") == F.col("of"), "left")
    # Links are given 1e-9 of a gram, see ``_near``.
    rows = rows.withColumn("room", shared * (1 + 1 / threshold) - F.col("grams") + 1e-6).where(F.col("room") >= threshold * F.col("grams")).drop("of", "alone")
    rows = written(rows, "linkable")
    least = written(rows.groupBy("path").agg(F.min("grams").alias("least")), "least")
    rows = rows.join(least, "path").where("room >= least").drop("room", "least")
    return rows.join(written(_mixed(rows.withColumn("parent", F.lit(0).cast("long"))).select("path", "n", "blocks"), "sizes"), "path")


def _merged(rows: DataFrame) -> DataFrame:
    """Large buckets that share their largest component as one bucket, where that is dealt out in fewer rows than all of them."""
    dealt = F.col("m1") * F.col("nr") + (F.col("n") - F.col("m1")) * (F.col("nd") + F.col("nr"))
    apart = rows.select("path", "c1", "n", "m1", "nd", "nr").distinct().groupBy("c1").agg(F.sum(dealt).alias("apart"), F.count("*").alias("buckets")).where("buckets > 1")
    one = rows.groupBy("c1", "t").agg(F.first("c").alias("c"), F.first("grams").alias("grams"), F.first("used").alias("used"))
    one = written(one, "merged")
    sizes = one.groupBy("c1").agg(F.count("*").alias("n"), F.sum("grams").alias("g"), F.count_if(F.col("c") == F.col("c1")).alias("m1"))
    sizes = _shares(sizes.withColumn("blocks", _blocks(F.col("n"), F.col("g"))).drop("g"))
    sizes = written(sizes.join(apart, "c1").where(dealt <= F.col("apart")).drop("apart", "buckets"), "sizes")
    one = one.join(sizes, "c1").withColumn("path", F.xxhash64(F.lit(1), "c1"))
    return rows.join(sizes, "c1", "left_anti").unionByName(one)


def _whole_tasks(sets: DataFrame, runs: int, gram_sets, threshold: float) -> DataFrame:
    """``task, t, c`` of the whole round; ``gram_sets`` gives ``t, grams`` of wanted ``t``.

    Large buckets are dealt, and not split, once that makes at most ``CHILDREN``
    times their rows, as their split would; or where splits end.
    """
    level, small, dealt, before = _split_roots(sets, SETTLING, runs), [], [], None
    for depth in range(DEPTH):
        sizes = _mixed(level)
        if before is not None:  # parents that a child resembles hold sets alike: they end as they are
            sizes = written(sizes, "sizes")
            of = before.select(F.col("path").alias("parent"), F.col("n").alias("of")).distinct()
            alike = written(sizes.join(of, "parent").where(F.col("n") >= ALIKE * F.col("of")).select("parent").distinct(), "alike")
            dealt.append(before.join(alike.withColumnRenamed("parent", "path"), "path", "left_semi"))
            sizes = sizes.join(alike, "parent", "left_anti")
        rows = _held(level, _once(sizes), "leaves")
        small.append(rows.where("blocks = 1").select(F.col("path").alias("task"), "t", "c"))
        large = rows.where("blocks > 1")
        if large.isEmpty():
            break
        if before is None:  # what is split further are these sets again
            large = written(_linkable(large, gram_sets(large.select("t").distinct()), threshold), "linkable")
            small.append(large.where("blocks = 1").select(F.col("path").alias("task"), "t", "c"))
            large = large.where("blocks > 1")
            if large.isEmpty():
                break
        large = written(_sides(large), "large")
        if depth == DEPTH - 1:
            dealt.append(large)
            break
        cheap = F.col("m1") * F.col("nr") + (F.col("n") - F.col("m1")) * (F.col("nd") + F.col("nr")) <= CHILDREN * F.col("n")
        dealt.append(large.where(cheap))
        before = large.where(~cheap)
        if before.isEmpty():
            break
        level = written(_split_more(before.join(sets.select("t", "sketch"), "t")), "paths")
    tasks = small[0]
    for part in small[1:]:
        tasks = tasks.unionByName(part)
    for part in dealt:
        tasks = tasks.unionByName(_dealt(_merged(part)))
    return tasks


def _dealt(rows: DataFrame) -> DataFrame:
    """Tasks of large buckets: each block of the rest meets each other one, and each block of the largest component."""
    d = rows.withColumn("top", F.col("c") == F.col("c1"))
    d = d.withColumn("block", F.pmod(F.xxhash64("t", "path"), F.when(F.col("top"), F.col("nd")).otherwise(F.col("nr"))).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("top"), F.col("nr")).otherwise(F.col("nr") + F.col("nd")) - 1)))
    among = ~F.col("top") & (F.col("other") < F.col("nr"))
    task = F.when(F.col("top"), F.xxhash64("path", F.lit(0), "other", "block"))
    task = task.when(among, F.xxhash64("path", F.lit(1), F.least("block", "other"), F.greatest("block", "other")))
    task = task.otherwise(F.xxhash64("path", F.lit(0), "block", F.col("other") - F.col("nr")))
    return d.select(task.alias("task"), "t", "c")


def _groups(batches, wanted):
    """Rows of each task, from batches sorted by task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = np.asarray(batch.column(0), np.int64)
        edges = np.flatnonzero(np.diff(task)) + 1
        starts = [0, *edges.tolist()]
        ends = [*edges.tolist(), batch.num_rows]
        for a, b in zip(starts, ends):
            part = batch.slice(a, b - a)
            if held and held[0].column(0)[0].as_py() != task[a]:
                yield wanted(held)
                held = []
            held.append(part)
    if held:
        yield wanted(held)


def _joined(held: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(held).combine_chunks()


def _screened(tasks: DataFrame, sets: DataFrame, screen: int) -> DataFrame:
    """``task, t, c`` of sets whose embedding has a partner of another component in their task."""
    rows = tasks.join(sets.select("t", "sketch"), "t").select("task", "t", "c", "sketch")
    rows = rows.repartition("task").sortWithinPartitions("task")

    def pick(held):
        d = _joined(held)
        if d.num_rows < 2:
            return None
        c = np.asarray(d.column("c"))
        if (c == c[0]).all():
            return None
        sketch = np.frombuffer(b"".join(d.column("sketch").to_pylist()), np.uint32).reshape(-1, EMBED)
        keep = np.zeros(len(c), bool)
        for i in range(len(c) - 1):
            near = ((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= screen) & (c[i + 1 :] != c[i])
            keep[i + 1 :] |= near
            keep[i] |= near.any()
        return d.select(["task", "t", "c"]).filter(pa.array(keep)) if keep.any() else None

    def run(batches):
        for found in _groups(batches, pick):
            if found is not None:
                yield from found.to_batches()

    return rows.mapInArrow(run, "task long, t binary, c long")


def _gram_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``t, grams`` of the wanted representatives (``key, x, t``)."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.join(wanted, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("x"))).select("t", "text")

    def run(batches):
        grams = Grams()
        for batch in batches:
            t, out = [], []
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x is not None and xxhash.xxh3_128_digest(x) == d:  # rows that share an id may differ
                    t.append(d)
                    out.append(grams(x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(out, pa.binary())], ["t", "grams"])

    return rows.mapInArrow(run, "t binary, grams binary").dropDuplicates(["t"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the grams that two sets or more hold."""
    n = len(sets)
    if n == 2:
        out = np.zeros((2, 2), np.int64)
        out[0, 1] = out[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return out
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[column]
    number = np.cumsum(shared) - 1
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _near(grams: pa.ChunkedArray, threshold: float) -> np.ndarray:
    """Which pairs of different sets reach the threshold."""
    sets = [np.frombuffer(g, np.uint64) for g in grams.to_pylist()]
    size = np.array([len(s) for s in sets])
    both = _overlaps(sets)
    near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    return near


def _verified(screened: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``u, v``: a spanning forest of each task's links, each set on the least one of its tree."""
    rows = screened.select("task", "t").join(sets, "t").select("task", "t", "grams").repartition("task").sortWithinPartitions("task")

    def verify(held):
        d = _joined(held)
        if d.num_rows < 2:
            return None
        names = d.column("t").to_pylist()
        near = _near(d.column("grams"), threshold)
        root = np.full(len(names), -1)
        for k in sorted(range(len(names)), key=names.__getitem__):
            if root[k] < 0:
                front = np.zeros(len(names), bool)
                front[k] = True
                while front.any():  # all that hangs together with the least one
                    root[front] = k
                    front = near[front].any(axis=0) & (root < 0)
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array([names[root[k]] for k in moved], pa.binary()), pa.array([names[k] for k in moved], pa.binary())], ["u", "v"])

    def run(batches):
        for found in _groups(batches, verify):
            if found is not None and found.num_rows:
                yield found

    return rows.mapInArrow(run, "u binary, v binary")


def _counted(roots: DataFrame, sets: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """``t, n_links`` of each set in a component (``v, root``): its links there, which are all it has."""
    held = roots.select(F.col("v").alias("t"), "root").unionByName(roots.select(F.col("root").alias("t"), "root").distinct())
    rows = written(held.join(sets.select("t", "n"), "t"), "members")
    sizes = rows.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("g"))
    sizes = sizes.select("root", _blocks(F.col("m"), F.col("g")).alias("blocks"))
    d = rows.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block"))
    d = d.select(task.alias("task"), side.alias("side"), "t").join(grams, "t").select("task", "side", "t", "grams")
    d = d.repartition("task").sortWithinPartitions("task")

    def count(held):
        d = _joined(held)
        side = np.asarray(d.column("side"))
        near = _near(d.column("grams"), threshold) if d.num_rows > 1 else np.zeros((1, 1), bool)
        near &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
        return pa.RecordBatch.from_arrays([d.column("t").combine_chunks(), pa.array(near.sum(axis=1), pa.int64())], ["t", "links"])

    def run(batches):
        yield from _groups(batches, count)

    return d.mapInArrow(run, "t binary, links long").groupBy("t").agg(F.sum("links").alias("n_links"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, links: bool = True) -> DataFrame:
    """One row per row of ``docs``.

    ``key``; ``class_id``: least id of the class, which links and equal texts
    join; ``n_links``: other texts with a similarity of ``threshold`` or more
    (null if ``links`` is false); ``n_copies``: rows with the same text;
    ``is_first``: whether the row stands for its class; ``text_hash``: Spark's
    ``xxhash64`` of the text, for joins back. A threshold for which the runs
    cannot reach ``TARGET_RECALL`` raises ``ValueError``.
    """
    how = plan(threshold)
    rows = written(sketches(docs, key, text), "sketches")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "n", "sketch", "x"))
    reps = written(rows.groupBy("t").agg(first.alias("r"), F.count("*").alias("n_copies")).select("t", "r.*", "n_copies").drop("none"), "texts")
    sets = reps.where("n > 0").select("t", "key", "x", "n", "sketch").withColumn("c", F.xxhash64("t"))

    grams: DataFrame | None = None

    def gram_sets(of: DataFrame) -> DataFrame:
        """The gram sets of all texts asked for so far, ``of`` among them."""
        nonlocal grams
        wanted = sets.select("key", "x", "t").join(of, "t")
        if grams is not None:
            wanted = wanted.join(grams.select("t"), "t", "left_anti")
        more = written(_gram_sets(docs, wanted, key, text), "grams")
        grams = more if grams is None else grams.unionByName(more)
        return grams

    def links_of(tasks: DataFrame) -> DataFrame:
        screened = written(_screened(tasks, sets, how.screen), "screened")
        return _verified(screened, gram_sets(screened.select("t").distinct()), threshold)

    found = links_of(_settling_tasks(sets))
    roots = components(found)
    sets = sets.join(roots.withColumnRenamed("v", "t"), "t", "left").withColumn("c", F.xxhash64(F.coalesce("root", "t"))).drop("root")
    sets = written(sets, "settled")
    more = links_of(_whole_tasks(sets, how.runs, gram_sets, threshold))
    roots = components(more.unionByName(roots.select(F.col("root").alias("u"), "v")))
    own = reps.select("t", "key", "n_copies").join(roots.withColumnRenamed("v", "t"), "t", "left")
    if links:
        own = own.join(_counted(roots, sets, grams, threshold), "t", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    else:
        own = own.withColumn("n_links", F.lit(None).cast("long"))
    own = written(own.withColumn("root", F.coalesce("root", "t")), "own")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("first"))
    first = first.select(F.col("root").alias("of"), F.col("first.key").alias("class_id"), F.col("first.t").alias("first_t"))
    own = own.join(first, F.col("root").eqNullSafe(F.col("of"))).select(F.col("t").alias("own_t"), "class_id", "first_t", "n_links", "n_copies")
    return (
        rows.select("key", "t", "x")
        .join(own, F.col("t").eqNullSafe(F.col("own_t")))
        .select(F.col("key").alias(key), "class_id", "n_links", "n_copies", (F.col("key").eqNullSafe(F.col("class_id")) & F.col("t").eqNullSafe(F.col("first_t"))).alias("is_first"), F.col("x").alias("text_hash"))
    )


def firsts(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class left, all its columns unchanged.

    The row with the class's least id stays; of rows equal in id and text, one.
    """
    marked = classes(docs, key, text, threshold, links=False).where("is_first")
    held = written(marked.groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("__rows")), "firsts")
    same = docs[f"`{key}`"].eqNullSafe(F.col("__key")) & (F.xxhash64(docs[f"`{text}`"]) == F.col("__hash"))
    out = docs.join(held.where("__rows = 1"), same, "left_semi")
    repeated = held.where("__rows > 1")
    if not repeated.isEmpty():
        out = out.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([key, text]))
    return out
