from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from candlewick.llm import decontaminate, jaccard_join, packing, quality_rules, sharding, substring_dedup
from candlewick.llm.components import components

VOCABULARY = [f"{a}{b}" for a in ("lo", "mi", "ta", "ko", "re", "su") for b in ("ra", "ne", "vi", "ß", "do", "x")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


# --- substring deduplication -------------------------------------------------


def placed(text):
    """Words of a text with their byte ranges."""
    return [(m[0], m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\v\f\r]+", (text or "").encode())]


def verify_repeats(rows, spans, least=51, whole=0.97):
    """Holds what was taken out of ``rows`` (id, text; in order, ids apart) against every word window of all texts.

    Words in ``least`` words that stand at an earlier place must be gone, ``whole`` of
    them and half of each stretch at least. Each byte taken out must lie in eight
    bytes that stand at an earlier place, in a span of ``MIN_WORDS`` words or more.
    Returns the share of the words that had to go and went.
    """
    known, seen = set(), set()
    due = gone = 0
    for (i, text), taken in zip(rows, spans):
        words, raw = placed(text), (text or "").encode()
        held = [False] * len(raw)
        for a, b in taken:
            assert len(raw[a:b].split()) >= substring_dedup.MIN_WORDS, i
            held[a:b] = [True] * (b - a)
        must = [False] * len(words)
        for k in range(len(words) - least + 1):
            g = tuple(w for w, _, _ in words[k : k + least])
            if g in known:
                must[k : k + least] = [True] * least
            known.add(g)
        lost = [held[a] and held[b - 1] for _, a, b in words]
        for on, part in itertools.groupby(range(len(words)), key=must.__getitem__):
            part = list(part)
            if on:
                n = sum(lost[k] for k in part)
                assert n >= 0.5 * len(part), (i, n, len(part))
                due, gone = due + len(part), gone + n
        found = [False] * len(raw)
        for k in range(len(raw) - 7):
            if raw[k : k + 8] in seen:
                found[k : k + 8] = [True] * 8
            seen.add(raw[k : k + 8])
        assert all(f for f, h in zip(found, held) if h), i
    assert gone >= whole * due
    return gone / due if due else 1.0


def taken_out(docs, rows):
    """Texts of ``docs`` after deduplication and the spans taken out, by (id, old text)."""
    old = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = {}
    for r in substring_dedup.deduplicated(docs.withColumn("old", F.col("text"))).collect():
        spans = [(x["start"], x["end"]) for x in r["__spans"]]
        if r["old"]:
            assert r["text"].encode() == substring_dedup.without(r["old"].encode(), spans)
        else:
            assert r["text"] == r["old"] and not spans
        got[r["doc_id"], r["old"]] = (r["text"], spans)
    assert set(got) == old
    return got


def test_substring_dedup(spark):
    rng = random.Random(11)
    passages = [prose(rng, n) for n in (51, 60, 80, 120)]
    rows, clean = [], {}
    for i in range(60):
        body = prose(rng, rng.randint(30, 200))
        if i % 3 == 0:
            w = body.split(" ")
            k = rng.randint(0, len(w))
            body = "\n".join([" ".join(w[:k]), passages[i // 3 % 4], " ".join(w[k:])])
        else:
            clean[i] = body
        rows.append((i, body))
    rows += [(70, None), (71, ""), (72, " \n"), (73, "z" * 200_000), (74, rows[1][1]), (75, prose(rng, 20_000))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, start int, h long, key int")
    out = substring_dedup.deduplicated(docs)
    assert out.columns == [*docs.columns, "__spans"]
    got = taken_out(docs, rows)
    assert verify_repeats(rows, [got[r][1] for r in rows]) > 0.99
    assert all(got[i, t] == (t, []) for i, t in clean.items())  # a later copy goes, the first stays
    assert got[74, rows[1][1]][0] == ""
    assert substring_dedup.deduplicated(docs.limit(0)).count() == 0


def test_substring_dedup_of_ids_that_are_shared_or_null(spark):
    """A null id is the first; rows equal in id and text are one document; rows that share an id only are several."""
    rng = random.Random(12)
    a, b, c = (prose(rng, 100) for _ in range(3))
    rows = [(None, a), (None, b), (1, a), (1, c), (1, c), (2, b + "\n" + c), (None, None), (3, None)]
    out = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = lambda i, t: sum(len((r["text"] or "").split()) for r in out if r["doc_id"] == i and t is None or r["doc_id"] == i and r["text"] == t)
    assert len(out) == len(rows)
    assert left(None, a) == left(None, b) == 100 and left(1, c) == 200
    assert left(1, None) <= 200 and left(2, None) <= 2


@pytest.mark.parametrize("n, reached, share", [(25, 0.95, 0.95), (30, 0.98, 0.98), (40, 0.99, 0.99), (51, 1, 0.99)])
def test_repeats_of_some_words(spark, n, reached, share):
    """Passages of ``n`` words in two contexts: how many lose words, and what share of all their words."""
    rng = random.Random(23)
    rows, passages = [], []
    for k in range(300):
        passages.append(" ".join(f"{rng.choice(VOCABULARY)}{rng.choice(VOCABULARY)}" for _ in range(n)))
        rows += [(k, f"{prose(rng, 30)} {passages[-1]} {prose(rng, 30)}"), (1000 + k, f"{prose(rng, 30)} {passages[-1]} {prose(rng, 30)}")]
    got = {r["doc_id"]: r for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["text"] == rows[2 * k][1] for k in range(300))
    lost = [60 + n - len(got[1000 + k]["text"].split()) for k in range(300)]
    print("lost", n, sum(x > 0 for x in lost) / 300, sum(lost) / (n * 300), min(lost))
    assert sum(x > 0 for x in lost) >= reached * 300 and sum(lost) >= share * n * 300 and max(lost) <= n + 4


def test_repeats_of_few_words_go(spark):
    """Passages of one to six distinct words in two contexts: the second place loses most of them."""
    rng = random.Random(13)
    for n, least in ((51, 0.98), (150, 0.98), (300, 0.98)):
        rows = []
        for k in range(200):
            vocabulary = prose(rng, 40).split()[: 1 + k % 6]
            passage = " ".join(rng.choice(vocabulary) for _ in range(n))
            rows += [(i, f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}") for i in (k, 1000 + k)]
        got = substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 1000").collect()
        lost = sum(bool(r["__spans"]) for r in got)
        print("few", n, lost / 200)
        assert lost >= least * 200, (n, lost)


def test_chunks_resist_shifts():
    rng = random.Random(12)
    a = prose(rng, 2000).encode()
    b = b"inserted " + a[:5000] + b"more" + a[5000:]
    split = lambda t: {t[x:y] for x, y in zip([0, *substring_dedup.cuts(t)], substring_dedup.cuts(t))}
    assert b"".join(t for t in [a[x:y] for x, y in zip([0, *substring_dedup.cuts(a)], substring_dedup.cuts(a))]) == a
    assert len(split(a) - split(b)) <= 8
    assert max(np.diff([0, *substring_dedup.cuts(b"q" * 10_000)])) <= substring_dedup.LONGEST


# --- n-gram join ---------------------------------------------------------------


def grams(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def join_by_hand(rows, threshold=0.8):
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(t, []).append(i)
    names = list(texts)
    sets = [grams(t) for t in names]
    links, up = [0] * len(names), list(range(len(names)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(names)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            up[find(a)] = find(b)
    least: dict = {}
    for k, t in enumerate(names):
        found = [i for i in (least.get(find(k)), *texts[t]) if i is not None]
        least[find(k)] = min(found, default=None)
    return by_id((i, least[find(k)], links[k], len(texts[t])) for k, t in enumerate(names) for i in texts[t])


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(rng, n, family):
    rows, base = [], [prose(rng, rng.randint(30, 150)) for _ in range(4)]
    common = prose(rng, 20)
    for i in range(n):
        kind = i % 5
        if kind == 0:
            rows.append(prose(rng, rng.randint(0, 120)))
        elif kind == 1:
            rows.append(common + " " + prose(rng, rng.randint(20, 60)))
        else:
            w = rng.choice(base[: 1 + i % 4]).split()
            for _ in range(rng.randint(0, family)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("bucket, threshold", [(512, 0.8), (6, 0.8), (6, 0.5)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, bucket, threshold):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    rng = random.Random(13)
    texts = corpus(rng, 150, 4) + [None, None, "", "", " ", "a b", "a  b", "a b c d e", "A, b! C dÉ", "a b c dé", "!? ..", "word " * 30_000, ("word " * 30_000).strip()]
    rows = list(enumerate(texts)) + [(0, texts[0]), (500, texts[3])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, t string, n int")
    got = by_id(tuple(r) for r in jaccard_join.classes(docs, threshold=threshold).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == join_by_hand(rows, threshold)
    if threshold == 0.8:
        kept = jaccard_join.firsts(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _, _ in got})


@pytest.mark.parametrize("threshold, edits", [(0.5, 12), (0.8, 5), (0.9, 3)])
def test_jaccard_join_finds_pairs_near_the_threshold(spark, threshold, edits):
    """Pairs of two texts only, at all similarities around the threshold: 0.99 of those that reach it are found, no other."""
    rng = random.Random(19)
    rows = []
    for k in range(400):
        w = [f"{rng.choice(VOCABULARY)}{rng.randint(0, 500)}" for _ in range(100)]
        rows.append((2 * k, " ".join(w)))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    want = {(a, b) for (a, s), (b, t) in zip(rows[::2], rows[1::2]) if len(grams(s) & grams(t)) >= threshold * len(grams(s) | grams(t)) - 1e-9}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["class_id"], r["doc_id"]) for r in jaccard_join.classes(docs, threshold=threshold).where("class_id != doc_id").collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and 50 < len(want) < 400, (len(got), len(want))


def test_jaccard_join_null_ids_and_a_threshold_out_of_reach(spark):
    """A null id never hides a link, and stands for a class only if no other id is there."""
    rng = random.Random(20)
    w = [f"{x}{k}" for k, x in enumerate(prose(rng, 120).split())]
    near, other = " ".join([*w[:60], "changed", *w[61:]]), " ".join(f"{x}{k}" for k, x in enumerate(prose(rng, 80).split()))
    rows = [(None, " ".join(w)), (4, near), (None, other), (None, other + " more"), (3, " ".join(w)), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(tuple(r) for r in jaccard_join.classes(docs).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == join_by_hand(rows)
    assert by_id((r["doc_id"],) for r in jaccard_join.firsts(docs).collect()) == [(3,), (9,), (None,)]
    with pytest.raises(ValueError):
        jaccard_join.classes(docs, threshold=0.2)


def test_jaccard_join_group_of_near_copies(spark, monkeypatch):
    """2,000 edits of one text, most of them linked to it alone, in blocks of 128: links and classes as by brute force; what
    the rounds deal out follows the group, not its square."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 128)
    rng = random.Random(21)
    base = [f"{rng.choice(VOCABULARY)}{k}" for k in range(150)]
    texts = {" ".join(base): None}
    while len(texts) < 2000:
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"{rng.choice(VOCABULARY)}{rng.randint(200, 9999)}"
        texts[" ".join(w)] = None
    rows = list(enumerate(texts)) + [(5000 + k, prose(rng, 60)) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = []
    screened = jaccard_join._screened
    monkeypatch.setattr(jaccard_join, "_screened", lambda tasks, *a: dealt.append(tasks.count()) or screened(tasks, *a))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect()}
    sets = [grams(t) for _, t in rows[:2000]]
    number: dict = {}
    m = np.zeros((2000, len(set().union(*sets))), np.float32)
    for k, s in enumerate(sets):
        m[k, [number.setdefault(g, len(number)) for g in s]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    near = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(near, False)
    assert [got[k][1] for k in range(2000)] == near.sum(axis=1).tolist()
    linked = np.flatnonzero(near[0])
    assert len(linked) > 1500 and all(got[int(k)][0] == 0 for k in linked)
    assert sum(dealt) <= (jaccard_join.SETTLING + jaccard_join.plan().runs) * jaccard_join.CHILDREN * 2200 * 3, dealt


@pytest.mark.parametrize("passage", [False, True])
def test_jaccard_join_large_groups_without_links(spark, monkeypatch, passage):
    """Copies too far from each other to link, beside a component or around a long passage, make rows in proportion, and no link is lost."""
    rng = random.Random(37)
    monkeypatch.setattr(jaccard_join, "BUCKET", 32)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(600):
        w = list(base)
        if passage and i % 10:
            w = w[:100] + [f"{i}_{k}" for k in range(60)]
        else:
            for k in rng.sample(range(150), rng.randint(0, 2) if i % 2 else rng.randint(5, 9)):
                w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    dealt = []
    screened = jaccard_join._screened
    monkeypatch.setattr(jaccard_join, "_screened", lambda tasks, *a: dealt.append(tasks.count()) or screened(tasks, *a))
    got = by_id(tuple(r) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links", "n_copies").collect())
    assert got == join_by_hand(rows)
    print("dealt", dealt)
    assert dealt[-1] <= 10 * len(rows)


def test_jaccard_join_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes(docs).count() == 0 and jaccard_join.firsts(docs).count() == 0
    assert jaccard_join.expected_recall(0.8, jaccard_join.plan(0.8)) >= jaccard_join.TARGET_RECALL


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000)).astype(np.uint64)) for _ in range(7)]
    got = jaccard_join._overlaps(sets)
    for a, b in itertools.combinations(range(7), 2):
        assert got[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist()))


def test_components(spark):
    rng = random.Random(14)
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(50)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(60)]
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up if find(x) != x}


# --- packing ---------------------------------------------------------------------

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_fill_is_closest():
    rng = random.Random(15)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        found = packing.fill(counts, sorted(counts, reverse=True), room)
        assert all(0 < n <= counts[k] for k, n in found.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)


def packed_well(rows, docs, capacity):
    """Checks the pieces of ``docs`` (id, text); returns the share of padding."""
    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return 1 - sum(r["length"] for r in rows) / (capacity * len(by))


def test_ids_of_odd_letters():
    """100,000 strings of letters that change with case, carry marks or come decomposed."""
    rng = random.Random(22)
    own, t = packing.ChunkTokenizer(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    latin = [chr(c) for c in range(0x20, 0x250)]
    marks = [chr(c) for c in range(0x300, 0x330)] + list("İıŉǰßſŁłǅǆΣσςΐµK\u212aÅ\u1e9eﬁ中\u200d\u00ad\u2028ё")
    pick = lambda: rng.choice(rng.choice((latin, latin, marks, ".,'abcIXÉéİ")))
    texts = ["".join(pick() for _ in range(rng.randint(1, 7))) + rng.choice(("", ".", ",", ".,")) for _ in range(100_000)]
    texts += ["İ.", "İ,", "aİ.", "İ", "éİ,x", "İstanbul, İ. x"]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, got, want in zip(part, own.ids(part), t.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_packing(spark, sf):
    odd = [None, "", "\n", "Éa. <|endoftext|>x, İI. ΣΑΣ, don't. we're, a.b,, ?!. x1. É, ß. \x1cq. \x85r, 12, .,", "á, É b.", "z" * 5000, "word, " * 9000]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(1000 + k, t) for k, t in enumerate(odd)] + [(1003, odd[3])]
    d = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, start int, rank int, salt string")
    for capacity in (2048, 64):
        assert packed_well(packing.pack(d, TOKENIZER, capacity=capacity).collect(), docs, capacity) < 0.05
    assert packing.pack(d.limit(0), TOKENIZER).count() == 0


# --- sharding ----------------------------------------------------------------------


def test_sharding(spark, tmp_path):
    rng = random.Random(16)
    rows = [(i, prose(rng, rng.randint(0, 40))) for i in range(3000)] + [(None, "x"), (5000, None), (5001, ""), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, size int, shard string")
    store = f"file://{tmp_path}/slots"
    out = sharding.sharded(docs, store).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    load: dict = {}
    for r in out:
        load.setdefault(r["shard"], []).append(r)
    assert sorted(load) == list(range(8))
    size = {k: sum(r["size"] for r in v) for k, v in load.items()}
    assert max(size.values()) - min(size.values()) <= max(r["size"] for r in out)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in load.values())
    old = sharding.SlotMap.load(spark, store)
    more = sharding.sharded(docs, store, 9).collect()
    new = sharding.SlotMap.load(spark, store)
    assert (old.version, new.version, new.n_shards) == (1, 2, 9) and sharding.SlotMap.load(spark, store, 1) == old
    assert all(b == 8 for a, b in zip(old.owner, new.owner) if a != b)  # the new shard alone takes slots
    again = sharding.sharded(docs, store, 9).collect()
    assert sorted(map(str, again)) == sorted(map(str, more)) and sharding.SlotMap.load(spark, store).version == 3
    assert {r["shard"] for r in more} == set(range(9))
    with pytest.raises(Exception):
        old.save(spark, store)
    assert sharding.sharded(docs.limit(0), f"file://{tmp_path}/none").count() == 0


# --- pipeline ------------------------------------------------------------------------


def windows(text, n=None):
    """Windows of ten words or a shorter item's own; of ``n`` words, if given."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = n or min(10, len(w))
    return [tuple(w[a : a + n]) for a in range(len(w) - n + 1)] if n else []


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(90_000, None, None, None, None), (90_001, "", "en", "s", 0)], docs.schema)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    rows = [(r["doc_id"], r["text"]) for r in now.collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        got = now.collect()
        if name == "quality":
            c = duckdb.connect()
            c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
            c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
            kept = {x for (x,) in c.execute(f"SELECT doc_id FROM ({quality_rules.oracle('documents', 'doc_id, kept')}) WHERE kept").fetchall()}
            rows = [r for r in rows if r[0] in kept]
        elif name == "near_duplicates":
            first = {c for _, c, _, _ in join_by_hand(rows)}
            rows = list(dict.fromkeys(r for r in rows if r[0] in first))
        elif name == "repeats":
            by = taken_out(spark.createDataFrame(rows, "doc_id long, text string"), rows)
            ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
            verify_repeats(ordered, [by[r][1] for r in ordered])
            rows = [(i, by[i, t][0]) for i, t in rows]
        elif name == "decontamination":
            held = {g for r in items.collect() for g in windows(r["text"])}
            rows = [r for r in rows if not held.intersection(g for n in range(1, 11) for g in windows(r[1], n))]
        else:
            assert packed_well(got, rows, packing.CAPACITY) < 0.2
            break
        assert now.columns == names
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows), name
        assert all(r["n_chars"] == len(r["text"]) for r in got) or name != "repeats"
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)


def test_pipeline_of_no_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
