from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from candlewick.llm import chat_format, queries, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n ", "a", "x " * 60, "the a b " * 400, "one\ntwo\none\n\n \none", "w\u2003v\u00a0u", "é" * 5000, "a b c a b c d", "\\ $1 % _ #*&|<>", " ".join(f"w{i}" for i in range(30_000))]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "k", "w", -1) for i, t in enumerate(texts)], "doc_id long, text string, __key string, n_words string, __t long")


def counted(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, sf):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    got = {r["doc_id"]: r for r in quality_rules.judged(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], counted(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t and t[:40])
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_repeats_by_the_windows_themselves(spark):
    """The way taken where hashes meet by chance counts the same."""
    rng = random.Random(3)
    texts = ODD[1:-1] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    d = docs(spark, texts).select("doc_id", F.filter(F.split("text", "[ \\t\\n]"), lambda x: x != "").alias("w"))
    got = {r["doc_id"]: r["n"] for r in d.select("doc_id", quality_rules._covered_by_words(F.col("w")).alias("n")).collect()}
    assert got == {i: counted(t)[4] for i, t in enumerate(texts)}


def test_kept_rows_keep_columns_and_repeats(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = d.unionByName(d.limit(20)).withColumn("__row", F.lit(1)).withColumn("__text", F.lit(2)).withColumn("kept", F.lit("x"))
    keep = {r["doc_id"] for r in quality_rules.judged(d).where("kept").select("doc_id").distinct().collect()}
    out = quality_rules.kept_rows(d)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in d.collect() if r["doc_id"] in keep)
    assert quality_rules.kept_rows(d.limit(0)).count() == 0


def test_rules_hold_against_labels(spark, sf):
    d = quality_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert d.where("quality = 0 AND kept").count() == 0
    assert d.where("quality = 1 AND NOT kept").count() <= 0.02 * d.where("quality = 1").count()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    c = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(names).collect()))) == sorted(map(str, c.fetchall()))


def chat(turns):
    turns = sorted(((t, r or "", x or "") for t, r, x in turns))
    loss = [x for _, r, x in turns if r == "assistant"]
    esc = lambda s: re.sub(r"([\\<>])", r"\\\1", s)
    whole = [f"<turn {esc(r)}>{esc(x)}</turn>\n" for _, r, x in turns]
    n = sum(len("".join(whole[: k + 1])) for k, (_, r, _) in enumerate(turns) if r == "assistant" or k == len(turns) - 1)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), sum(map(len, loss)), sha("".join(loss)), n


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["</turn>\n", "<turn assistant>", "\\", "\\\\<", ">", "$1", "é😀", "\n", "a b", "", "<", "\\n"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "odd>role\\", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(6))]), "x", 1))
    rows += [(60, 0, "user", "only", "x", 1), (61, 1, "assistant", "twice", "x", 1), (61, 1, "assistant", "twice", "x", 1), (62, 0, "assistant", "z" * 200_000, "x", 1), (None, 0, "user", "null key", "x", 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ts string, example long")
    d = chat_format.with_hostile(d)
    got = {r[0]: tuple(r)[1:] for r in chat_format.digests(chat_format.examples(d)).collect()}
    by: dict = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t, r, x))
    by[-7] = [(0, "user", chat_format.HOSTILE[1]), (1, "assistant", chat_format.HOSTILE[1])]
    assert got == {c: chat(ts) for c, ts in by.items()}
    ex = chat_format.examples(d).where("conv_id = -7").collect()
    assert [(e["target"], e["closing"]) for e in ex] == [(r"\\### Assistant: \</turn\> ok", "</turn>\n")]
    assert chat_format.digests(chat_format.examples(d.limit(0))).count() == 0


URLS = [None, "", "nohost/com/", "http://", "http://a.com", "http://A.COM/x", "x://www.example.com/en/1", "https://example.com/en/2?q=1", "https://b.example.com/en/", "https://badexample.com/en/", "http://q.net/es/a#b", "http://q.net/ES/", "http://q.net?/es/", "http://É.NET/fr/x", "http://com/", "http://x.org/casino/1", "HTTP://u@x.com:80/p://q"]


def listed(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1])
        path = m[2]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r["page_id"]: r for r in url_filter.judged(pages, none).collect()}
    assert len(got) == len(URLS) + 3
    for i, u in enumerate(URLS + URLS[:3]):
        host, path, rule, verdict = listed(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), u


def tokens(url):
    out = set()
    s, rest = url.split("://", 1)
    host, _, path = rest.partition("/")
    path, _, query = path.partition("?")
    out.add("s:" + s)
    out |= {"h:" + x for x in re.split("[^a-z0-9]+", host) if x} | {"p:" + x for x in re.split("[^a-z0-9]+", path) if x}
    return out | {"q:" + x.split("=")[0] for x in query.split("&") if x}


def test_url_association_rules(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        host, section, q = rng.choice(["one", "two", "three"]), rng.choice(["news", "play", "shop"]), rng.choice(["", "?ref=1"])
        bad = host == "two" and section == "play" or rng.random() < 0.05
        rows.append((f"https://{host}.org/{section}/{i}{q}", bad))
    labelled = spark.createDataFrame(rows + [("https://n.org/1", None), (None, True)], "url string, bad boolean")
    rules = [(r["items"], r["confidence"], r["anchors"]) for r in url_filter.mined(labelled).collect()]
    assert [r[0] for r in rules] == [[["h:two"], ["p:play"]]] and rules[0][2] in rules[0][0]
    with_both = [b for u, b in rows if {"h:two", "p:play"} <= tokens(u)]
    assert abs(rules[0][1] - sum(with_both) / len(with_both)) < 1e-9
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labelled).collect()}
    assert got == {i: "block" if {"h:two", "p:play"} <= tokens(u) else "allow" for i, (u, _) in enumerate(rows)}


def test_url_rules_need_as_many_pages_at_every_size(spark):
    rows = [(f"https://site{i % 5000}.org/{i}", False) for i in range(30_000)] + [(f"https://rare.net/{i}", True) for i in range(12)]
    rules = url_filter.mined(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert [r["items"] for r in rules] == [[["h:net", "h:rare"]]]  # both say the same
    assert {round(r["support_count"]) for r in rules} == {12}


def test_url_rules_by_brute_force(spark):
    """Every set of up to three tokens is tried; a repeated url of 40 tokens is one item beside the rest."""
    rng = random.Random(9)
    long = "https://spam.org/" + "/".join(f"part{k}" for k in range(38))
    rows = [(f"https://{rng.choice('ab')}.com/{rng.choice('xyz')}/{rng.choice('pq')}/{i}", False) for i in range(400)]
    rows = [(u, "a.com/x" in u and rng.random() < 0.95 or "/y/q" in u and rng.random() < 0.9 or rng.random() < 0.02) for u, _ in rows] + [(long, True)] * 1000
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = url_filter.mined(labelled).collect()
    by, of_bad = (Counter(t for u, b in rows if b or k for t in tokens(u)) for k in (1, 0))
    usable = sorted(t for t in by if by[t] < len(rows) and of_bad[t] >= url_filter.MIN_COUNT and not t.startswith("p:part") and t not in ("h:spam", "h:org"))
    sure = {}
    for k in (1, 2, 3):
        for ts in itertools.combinations(usable, k):
            held = [b for u, b in rows if tokens(u).issuperset(ts)]
            if sum(held) >= url_filter.MIN_COUNT:
                c = sum(held) / len(held)
                if c - 2 * (c * (1 - c) / len(held)) ** 0.5 >= url_filter.MIN_CONFIDENCE:
                    sure[ts] = c
    want = {ts for ts, c in sure.items() if not any(set(p) < set(ts) and sure[p] >= c for p in sure)}
    spam = [r for r in got if ["h:spam"] == [t for x in r["items"] for t in x if t.startswith("h:s")]]
    assert len(spam) == 1 and len(spam[0]["items"]) == 1 and len(spam[0]["items"][0]) == 40  # and h:org
    rest = [r["items"] for r in got if r is not spam[0]]
    assert sorted(tuple(sorted(x[0] for x in items)) for items in rest) == sorted(want) and want
    pages = spark.createDataFrame([(0, "http://y.org/a"), (1, "http://a.info/x"), (2, "http://z.net/part7")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judged(pages, labelled).collect()} == {0: "block", 1: "block", 2: "block"}
