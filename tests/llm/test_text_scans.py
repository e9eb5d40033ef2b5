from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from candlewick.llm import decontaminate, html_extract, license_scan

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        n = min(10, len(p))
        for a in range(len(p) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == p[a : a + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    names = sorted(map(str, found - {None}))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_search_tables_are_small_and_exact():
    """Windows of a large item set, many of which end in the same words."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(3000)] + ["of", "the"] * 1500
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 400))).encode()) for k in range(1000)]
    found = decontaminate.Items(items)
    windows = sum(len(s.starts) for s in found.searchers)
    size = sum(x.nbytes for s in found.searchers for x in (s.keys, s.shift, s.place, s.starts))
    assert size < 32 * windows
    known = {}
    for k, t in items:
        w = t.decode().split()
        n = min(10, len(w))
        for a in range(len(w) - n + 1):
            known.setdefault(tuple(w[a : a + n]), set()).add(k)
    texts, wanted = [], []
    for _ in range(300):
        own = items[rng.randrange(1000)][1].decode().split()
        w = [rng.choice(vocabulary) for _ in range(30)] + own[rng.randint(0, 20) : rng.randint(21, 60)] + [rng.choice([*vocabulary, "never"]) for _ in range(30)]
        want = {k for n in range(1, 11) for a in range(len(w) - n + 1) for k in known.get(tuple(w[a : a + n]), ())}
        texts.append([x.encode() for x in w])
        wanted.append(want)
    assert [(bool(spans), got) for spans, got in map(found.find, texts)] == [(bool(x), x) for x in wanted]


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["a", "the", "of", "Éa", "x1", "ünd"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(0, 14))) for i in range(25)] + [(3, line(12)), (90, None), (91, "..."), (92, "solo"), (None, line(11))]
    texts = [None, "", "!!", "SOLO", "so-lo solo_"] + [line(rng.randint(1, 60)) for _ in range(40)]
    texts += [line(5) + ", " + (t or "").upper().replace(" ", "\n- ") + "; " + line(5) for _, t in items[:12]] + [line(3000)]
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id long")
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, n_words string")
    want = {i: brute(t, items) for i, t in enumerate(texts + texts[:2])}
    for block in (decontaminate.BLOCK_BYTES, 150):
        got = {r[0]: tuple(r)[1:6] for r in decontaminate.scan(docs, bench, block_bytes=block).collect()}
        assert got == want
        kept = decontaminate.clean_rows(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in want.items() if not x[4]]
    assert decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(docs.limit(0), bench).count() == 0


ARTICLE = """<article class="post"><header><h1>Ti&amp;tle</h1></header><p>One <b>two</b>
 three<p>Four<br>five &copy; &nbsp; x<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><div class="ad">buy</div>
<form>f<input></form><script>var a="</p>";</script><div class='share-bar'>s</div><section id="comments"><p>c</p></section><!-- x > y --><pre>a
 b</pre></article>"""
WANT = "Ti&tle\nOne two three\nFour\nfive © x\na\nb\n1 2\n3\na b"


def wrapped(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class='home ads-free'><header><h1>Site</h1></header><nav>menu</nav><div id=cookie-notice>We use</div><main>{body}</main><aside>side</aside><footer>foot</footer></body></html>"


def test_article():
    assert html_extract.text_of(html_extract.parse(wrapped(ARTICLE))) == WANT
    assert html_extract.text_of(html_extract.parse("<p>a &lt;b&gt; &#233;&amp;amp;<p>c")) == "a <b> é&amp;\nc"


def test_text_of_an_article_does_not_go_by_its_name():
    read = lambda h: html_extract.text_of(html_extract.parse(h))
    assert read('<article><p>Body.</p><p class="notice">Of note.</p><h2 id="social">Social history</h2></article>') == "Body.\nOf note.\nSocial history"
    assert read('<article><section id="respond-to-climate"><p>How to.</p></section><div id="widget-theory-of-change"><p>So.</p></div></article>') == "How to.\nSo."
    assert read('<article><p>a</p><div class="post-comments x">c</div><div class="box adBox">b</div><ul class="share-buttons"><li>s</ul></article>') == "a"
    assert read('<body><p class="notice">Of note.</p><div class="cookie-law-x">c</div><p>b</p></body>') == "Of note.\nb"


def test_wrappers_around_the_article_stay():
    read = lambda h: html_extract.text_of(html_extract.parse(h))
    long = "The story goes on and on, word after word. " * 3
    assert read(f"<body><form action=x><nav>m</nav><article><p>{long}</article></form></body>") == long.strip()
    assert read(f"<body><div class='page with-sidebar'><div id=menu>m</div><article><p>{long}</p></article><div class=sidebar>s</div></div></body>") == long.strip()
    assert read(f"<body><div class='has-banner'><p>{long}</p><div class=ad>a</div></div></body>") == long.strip()
    assert read(f"<article><p>a</p></article><div class=comments><article class=comment><p>{long}</p></article></div>") == "a"


def test_broken_markup():
    for source in ["", "<", "<p", "a<b", "</p></div>x", "<!--", 'a<b c="', "<script>x", "<div>" * 30_000 + "deep" + "</div>" * 10, "<" * 30_000, "<a b='" + "'\"" * 5000, "<p></b></i>x</p>", "\x00<p>\ud7ff"]:
        html_extract.text_of(html_extract.parse(source))
    assert html_extract.text_of(html_extract.parse("<div>" * 30_000 + "deep")) == "deep"
    assert html_extract.text_of(html_extract.parse("<p>x < y && z</p>")) == "x < y && z"


def test_long_attribute_values():
    read = lambda h: html_extract.text_of(html_extract.parse(h))
    for quote in "\"'":
        assert read(f"<article><p data-x={quote}{'a > b ' * 20_000}{quote}>text</p><p class=x>more</article>") == "text\nmore"
    assert read("<article><p title=it's>don't</p><a b=\"" + "<c d=\"'" * 20_000) == "don't"


def test_template_goes_and_articles_stay(spark):
    template = "<section class=k{0}><p>Follow our channel for more</p><p>Every day</p></section>"
    rows = []
    for i in range(12):
        rows.append((i, f"http://a.org/{i}", f"<html><body><article><p>Story {i}</p><p>A shared paragraph.</p>{template.format('')}</article></body></html>"))
    rows += [(100 + i, "http://a.org/c", rows[0][2]) for i in range(4)]  # copies of one page
    rows += [(200 + i, f"http://b.org/{i}", f"<body><div>Menu of b</div><p>Text {i}</p></body>") for i in range(8)]
    rows += [(300, "http://c.org/", "<body><div>Menu of b</div><p>Alone</p></body>"), (301, None, None), (302, "x", ""), (0, "http://a.org/0", "<p>other</p>")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars long")
    got = html_extract.extracted(pages).collect()
    by = {(r["page_id"], r["text"]) for r in got}
    assert len(got) == len(rows)
    for i in range(12):
        assert (i, f"Story {i}\nA shared paragraph.") in by
    assert all((100 + i, "Story 0\nA shared paragraph.") in by for i in range(4))
    assert all((200 + i, f"Text {i}") in by for i in range(8))
    assert {(300, "Menu of b\nAlone"), (301, ""), (302, ""), (0, "other")} <= by
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extracted(pages.limit(0)).count() == 0


def test_text_blocks_on_every_page_go(spark):
    """A notice in the article of every page goes; a paragraph of fewer articles stays."""
    notice = "<p>Subscribe to our letter for more stories.</p>"
    rows = [(i, f"http://a.org/{i}", f"<body><nav><ul><li>Home</li></ul></nav><article><p>Story {i}</p>{notice}{'<p>Some share this.</p>' if i < 15 else ''}</article></body>") for i in range(40)]
    got = {r["page_id"]: r for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == (f"Story {i}\nSome share this." if i < 15 else f"Story {i}") for i in range(40))
    assert {r["n_template"] for r in got.values()} == {1}


def test_template_of_a_part_of_a_large_host_goes(spark):
    box = "<section><p>More of this series</p></section>"
    rows = [(i, f"http://a.org/{i}", f"<body><article><p>Story {i}</p>{box if i < 6 else ''}</article></body>") for i in range(60)]
    note = "<p>This week only, read all our old issues for free.</p>"
    rows += [(100 + i, f"http://b.org/{i}", f"<body><p>Story {i}</p>{note if i < 30 else ''}{'<p>Yes.</p>' if i < 30 else ''}</body>") for i in range(200)]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}" for i in range(60))
    assert all(got[100 + i] == f"Story {i}" + ("\nYes." if i < 30 else "") for i in range(200))


def test_templates_of_all_hosts_against_brute_force(spark):
    """Random trees of boxes and paragraphs on twelve hosts; recurring ones are counted over pages as plain tuples."""
    rng = random.Random(17)
    sentence = lambda n: " ".join(rng.choice(["sun", "moon", "star", "sky", "sea"]) + str(rng.randint(0, 99)) for _ in range(n))

    def tree(depth):
        if not depth or rng.random() < 0.5:
            return ("p", (sentence(rng.randint(1, 12)),))
        return (rng.choice(["div", "section", "ul"]), tuple(tree(depth - 1) for _ in range(rng.randint(1, 3))))

    show = lambda t: t if isinstance(t, str) else f"<{t[0]}>{''.join(map(show, t[1]))}</{t[0]}>"
    parts = lambda t: [] if isinstance(t, str) else [t, *(x for c in t[1] for x in parts(c))]
    pages = {}
    for host in range(12):
        pool, n = [tree(3) for _ in range(12)], rng.choice([4, 20, 60, 160])
        for k in range(n):
            body = [tree(3) for _ in range(rng.randint(1, 4))] + [x for i, x in enumerate(pool) if rng.random() < 0.02 * (i + 1) ** 1.5]
            rng.shuffle(body)
            pages[host * 1000 + k] = body
    rows = [(i, f"http://h{i // 1000}.org/{i}", f"<html><body>{''.join(map(show, b))}</body></html>") for i, b in pages.items()]
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(spark.createDataFrame(rows + rows[:40], "page_id long, url string, html string")).collect()}
    counts, size = Counter(), Counter()
    for i, b in pages.items():
        size[i // 1000] += 1
        counts.update({(i // 1000, x) for t in b for x in parts(t)})

    def left(host, t):
        n = counts[host, t]
        if n >= 5 and (t[0] != "p" or n >= 0.2 * size[host] or n >= 30 and len(t[1][0].split()) >= 8):
            return []
        return [t[1][0]] if t[0] == "p" else [x for c in t[1] for x in left(host, c)]

    assert got == {i: "\n".join(x for t in b for x in left(i // 1000, t)) for i, b in pages.items()}
    assert sum(len(left(i // 1000, t)) == 0 for i, b in pages.items() for t in b) > 500


def test_pages_against_plain_reading(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extracted(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("<p>|</p>|<br>|</?h1>", body))
        assert got[p["page_id"]] == "\n".join(b for b in blocks if b)


def test_notices():
    t = license_scan.Templates()
    read = lambda s: [(a, v, n) for a, v, _, n, _ in license_scan.notices(s, t)]
    assert read("Licensed under the Apache License, Version 2.0.\nprose follows here with many other words") == [("Apache", "2.0", 0)]
    assert read("a\n\nThis work is licensed under the GNU General Public License, version 3.") == [("GPL", "3", 2)]
    assert read("# Released under the MIT license") == [("MIT", "", 0)]
    assert read("the driver's license was renewed by an officer in the town hall this week") == []
    assert read("") == read("nothing here") == []
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in the\nSoftware without restriction"
    assert read(wrapped)[0][0] == "MIT"
    far = "Copyright 2020 A\n" + "\n" * 40 + wrapped.replace(" ", "\n")  # a notice of over 20 lines
    assert read(far)[0][0] == "MIT"


FILES = {
    "MIT": "MIT License\n\nCopyright (c) 2020 John Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "BSD": "Copyright (c) 2019, The Project Authors\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce",
    "Apache": "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,",
    "ISC": "ISC License\n\nCopyright (c) 2004-2010 by Internet Systems Consortium, Inc.\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "GPL": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>",
    "LGPL": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
    "AGPL": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n",
    "MPL": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"",
    "Proprietary": "Copyright (c) 2021 The ACME Authors. All rights reserved.\n\nint main() {",
}


def cosine(text, template):
    """Of TF-IDF vectors, by the definition."""
    w = lambda t: ["0" if x[0].isdigit() else x.lower() for x in re.findall(r"[a-zA-Z]+|[0-9]+(?:\.[0-9]+)*", t)]
    vector = lambda t: Counter([*w(t), *zip(w(t), w(t)[1:])])
    every = [set(vector(t)) for _, t in license_scan.TEMPLATES]
    idf = lambda k: math.log((1 + len(every)) / (1 + sum(k in e for e in every))) + 1
    a, b = ({k: v * idf(k) for k, v in vector(t).items()} for t in (text, template))
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(k, 0) for k, x in a.items()) / (size(a) * size(b) or 1)


def test_licence_files_against_brute_force():
    t = license_scan.Templates()
    for name, text in FILES.items():
        found = license_scan.notices(text, t)
        assert license_scan.chosen(found)[0] == name, (name, found)
        lines = text.split("\n")
        for got, _, score, at, _ in found:  # the best of all runs of lines from the notice's first that lines improve
            best, run = max((round(cosine("\n".join(lines[at:n]), x), 9), n) for n in range(at + 1, len(lines) + 1) for _, x in license_scan.TEMPLATES)
            assert abs(best - score) < 1e-8
            assert max((round(cosine("\n".join(lines[at:run]), x), 9), len(x), y) for y, x in license_scan.TEMPLATES)[2] == got


def brute_licence(path, own, files):
    """Nearest licence file at or above the path's directory."""
    if path is None:
        return None
    parts = [x for x in path.split("/")[:-1] if x]
    for k in range(len(parts), -1, -1):
        at = parts[:k]
        held = [(s, o) for p, o, s in files if p is not None and o and re.search(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$", p) and [x for x in p.split("/")[:-1] if x] == at]
        if held:
            return min((o == license_scan.WEAK, -s, o) for s, o in held)[2]
    return None


def test_inheritance_against_brute_force(spark):
    rng = random.Random(8)
    notice = {"MIT": "Released under the MIT License.", "Apache": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3."}
    rows = [(-1, None, "prose", 1), (-2, "top.txt", None, 1), (-3, "/abs//a/x.txt", "", 1), (-4, "LICENSES/x", notice["MIT"], 1)]
    for i in range(250):
        depth = rng.randint(0, 4)
        folder = "/".join(rng.choice("ab") for _ in range(depth))
        name = rng.choice(["f.py", "g.txt", "LICENSE", "COPYING.md", "licence-x"]) if rng.random() < 0.15 else f"{i}.py"
        own = rng.choice(list(notice)) if rng.random() < 0.12 else None
        rows.append((i, f"{folder}/{name}" if folder else name, (notice[own] + "\n" if own else "") + "some words", 1))
    rows.append(rows[-1])
    rows += [(900, "tie/LICENSE", notice["MIT"], 1), (901, "tie/COPYING", "Licensed under CC BY 4.0.", 1), (902, "tie/x.py", "words", 1), (903, "tie/NOTICE", "All rights reserved.", 1)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string, licence long")
    got = license_scan.scan(files).collect()
    assert len(got) == len(rows)
    own = {}
    for i, p, text, _ in rows:  # a file has its whole notice or none
        held = [(round(cosine(line, x), 9), len(x), y) for line in (text or "").split("\n")[:1] for y, x in license_scan.TEMPLATES]
        own[i] = (max(held)[2], max(held)[0]) if held and max(held)[0] >= license_scan.THRESHOLD else (None, None)
    held = [(p, *own[i]) for i, p, _, _ in rows]
    for r in got:
        mine = own[r["doc_id"]][0]
        want = mine or brute_licence(r["path"], None, held)
        assert r["licence"] == want and r["own"] == mine, r
        assert r["source"] == ("own" if mine else "inherited" if want else "none")
    assert license_scan.scan(files.where(F.lit(False))).count() == 0
