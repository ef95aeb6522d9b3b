"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from kindred.llm import jaccard_forest, licences, long_repeats, main_text, mixing, near_vectors, order_minhash, pieces, registry, toxicity, warc

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WS.findall(t or "")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, junk, blanks and nulls."""
    r = random.Random(11)
    voc = ["w%d" % i for i in range(400)] + ["é", "漢字", "the", "of", "x,"]
    line = lambda n: " ".join(r.choice(voc) for _ in range(n))
    out = [None, "", "  \n", "one", "one", "a b c", "the " * 300, "ab " * 200 + "cd " * 200, "x" * 5000]
    passage = [line(50), line(36), line(34)]
    for _ in range(40):
        base = line(r.randint(1, 160))
        out.append(base)
        for _ in range(r.randint(0, 3)):
            ws = base.split(" ")
            for _ in range(r.randint(0, 4)):
                ws[r.randrange(len(ws))] = r.choice(voc)
            out.append(" ".join(ws))
        if r.random() < 0.5:
            out.append(line(r.randint(0, 20)) + "\n" + r.choice(passage) + " " + line(r.randint(0, 20)))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], ("s0", "s0", "s1", "s2", None)[i % 5], None if t is None else len(t)) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns with names that operators use themselves."""
    return docs.withColumn("k", F.lit(1)).withColumn("t", F.lit("x")).withColumn("sha", F.lit("y")).withColumn("n", F.lit(2)).withColumn("digest", F.lit("z")).withColumn("row", F.lit(0)).withColumn("size", F.lit(7)).withColumn("score", F.lit(0.5)).withColumn("ids", F.lit("q")).withColumns({c: F.lit(3) for c in ("_k", "_d", "_size", "_copies", "_taken", "_toxicity", "toxicity", "doc", "turn", "cut", "mix", "w", "c", "i", "g", "rid", "th", "path")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_vectors(rows, t=0.93):
    ok = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = collections.Counter(), {i: i for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], dtype=np.float32).astype(float) for i in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    n[a] += 1
                    u, v = a, b
                    while root[u] != u:
                        u = root[u]
                    while root[v] != v:
                        v = root[v]
                    root[max(u, v, key=lambda i: rows[i][0])] = min(u, v, key=lambda i: rows[i][0])
    out = []
    for i, (k, _, _) in enumerate(rows):
        u = i
        while root[u] != u:
            u = root[u]
        out.append((k, n[i], rows[u][0], k == rows[u][0]))
    return sorted(out)


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.4])).tolist(), int(i % 12 % 3)) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(30)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] + [1.0] * 15, 0), (403, rows[0][1], None), (404, [1.0, 2.0], 0), (405, [2.0, 4.0], 0), (406, [], 1), (407, [None, 1.0], 1)]
    got = sorted(tuple(r)[:4] for r in near_vectors.near_vectors(vectors(spark, rows), block=24).collect())
    assert got == brute_vectors(rows)


def test_near_vectors_without_rows(spark):
    assert near_vectors.near_vectors(vectors(spark, [])).collect() == []
    got = near_vectors.near_vectors(vectors(spark, [(None, [1.0], 1), (5, [1.0], 1), (5, [1.0], 1)])).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id) for r in got) == [(False, 5, 2, 5), (False, 5, 2, 5), (True, None, 2, None)]


def test_bound_stops_before_the_last_axis():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 32)), rng.normal(size=(50, 32))
    b[:10] = a[:10] + 0.01
    i, j = near_vectors.linked_in_tile(a, b, None, 0.9, step=4)
    c = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None]
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(c >= 0.9))))


# 2


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site <a>Home</a></header><nav><ul><li><a>A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Big &amp; small</h1><p>One two <b>three</b>
 four&nbsp;five.</p><script>var x="</p>"</script><aside>side</aside><div class='ad'>Buy <div>now</div></div><p>Second paragraph of the article here</p><form>name</form><section id=comments><p>nice</p></section></article>
<div class=sidebar>links</div><footer>end</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text.main_text(PAGE) == "Big & small\nOne two three four five.\nSecond paragraph of the article here"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!--", "<script>x", "&", "<nav>x</nav>", "</p></div>", "<a href='" + "x" * 10000])
def test_main_text_of_odd_pages(page):
    assert isinstance(main_text.main_text(page), str)


@pytest.mark.parametrize("attrs", ['title="The hidden valley"', 'data-hidden="false"', "data-state='hidden'", "data-state=hidden", 'data-class="sidebar"', "title='id=nav'", 'x-id=ad data-role="menu"', "data-style='display:none'", '"hidden"'])
def test_main_text_tells_attributes_from_values(attrs):
    p = "<p>Some words of the article that stand in one wrapper.</p>"
    assert main_text.main_text(f"<body><div {attrs}>{p}{p}</div></body>") == "\n".join([p[3:-4]] * 2)


@pytest.mark.parametrize("attrs", ["hidden", "title='x' hidden", "HIDDEN=''", "a=b/ hidden", "class = 'sidebar'", "id=nav", 'style="display: none"', "aria-hidden=true", "title='a>b' role=\"menu\"", "title=x\nclass=ad"])
def test_main_text_leaves_marked_elements_out(attrs):
    p = "<p>Some words of the article that stand in one wrapper.</p>"
    assert main_text.main_text(f"<body>{p}{p}<div {attrs}><p>gone</p></div>{p}</body>") == "\n".join([p[3:-4]] * 3)


def test_main_text_weights_are_learnt():
    w = main_text.weights()
    assert w.of(frozenset()) > 0 > w.of(frozenset(["a"])) and max(w.tag.values()) <= 0 and w.skip < 0
    for f in ("nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "header", "hint"):
        assert w.unlikely({f}) and not w.unlikely({f"{f} around"})
    for layout in main_text.LAYOUTS:  # finds again what it was shown, but for headings and the like
        layout = layout.replace("{l}", "<a href='/'>out out</a>").replace("{s}", "w " * 9).replace("{p}", "w " * 45)
        want = sum(len(re.sub("<[^>]*>", " ", x).split()) for x in re.split("[«»]", layout)[1::2])
        got = main_text.main_text(layout.replace("«", "").replace("»", "")).split()
        assert abs(len(got) - want) <= 0.1 * want


SENTENCE = "Some words of the article that stand in one wrapper."


@pytest.mark.parametrize("cls", ["content-with-sidebar", "post ad-free", "has-comments", "layout no-sidebar", "entry share-enabled", "related-topic", "sidebar", "comments", "wrapper-nav", "ad"])
def test_main_text_keeps_what_a_hostile_name_wraps(cls):
    body = "<h1>The title</h1>" + f"<p>{SENTENCE}</p>" * 3
    want = "\n".join(["The title"] + [SENTENCE] * 3)
    assert main_text.main_text(f"<body><nav><a>x</a></nav><div class='{cls}'>{body}</div><footer>end</footer></body>") == want
    assert main_text.main_text(f"<body><div id={cls}><article>{body}</article><div class=comments><p>nice</p></div></div><aside>x y</aside></body>") == want


@pytest.mark.parametrize(
    "page",
    [
        "<nav><a>A</a><a>B</a><article>{}</article><footer>x",  # menu that is never closed
        "<div class=menu><ul><li>A<li>B</ul></div><div>{}</div><div class='comment-list'><article><p>I like this very much, it is nice.</p></article></div>",
        "<table><tr><td><a>A</a><td>{}</table><div id=respond>Leave a reply</div>",
        "<form><input><div>{}</div></form><div role=contentinfo>c</div>",
        "<div><div><div><section>{}</section></div></div></div><p>Sign up for our newsletter today</p>",
        "<header>Site <a>Home</a></header><main>{}<form>name</form></main><aside>x",
        "<!-- c --><style>p{{}}</style><noscript>x</noscript><div>{}</div><script>var x='<p>y</p>'</script><div class='cookie-bar'>We use cookies</div>",
        "<article><header>{}</header></article><section class='related-posts'><p>More of the same</p></section>",
    ],
)
def test_main_text_of_layouts_unlike_the_labelled_ones(page):
    p = f"<p>{SENTENCE}</p>" * 2 + "<div class='ad-slot'><p>Buy one now</p></div>" + f"<p>{SENTENCE}</p>"
    assert main_text.main_text(f"<html><body>{page.format(p)}</body></html>") == "\n".join([SENTENCE] * 3)


def test_main_text_of_long_and_repeated_pages(spark):
    long = "<nav>x</nav><article>" + f"<p>{SENTENCE} <a>link</a></p>" * 20000 + "</article>"
    df = spark.createDataFrame([(1, long, "a", 0), (1, long, "a", 0), (2, None, "b", 1), (3, "", None, 2)], "page_id long, html string, text string, s int")
    got = sorted((r.page_id, len(r.text), r.s) for r in main_text.extract_main_text(df).collect())
    n = 20000 * (len(SENTENCE) + 6) - 1
    assert got == [(1, n, 0), (1, n, 0), (2, 0, 1), (3, 0, 2)]
    assert main_text.extract_main_text(df.limit(0)).collect() == []


def test_main_text_over_pages(spark, sf_dir):
    import html

    def plain(h):
        a = re.search(r"<article>(.*?)(</article>|$)", h, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", a)
        return "\n".join(x for x in (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts) if x)

    src = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.op2_main_text(spark, sf_dir).collect()}
    assert got == {k: (plain(h), len(plain(h))) for k, h in src.items()}


# 3


@pytest.fixture(scope="module")
def model():
    P = pytest.importorskip("public_tokenizers")
    return pieces.PieceModel.load(P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_pieces_like_the_library(spark, model, library, docs, texts):
    got = sorted((r.doc_id, r.n_tokens, sha(bytes(r.ids)), r.decoded) for r in pieces.with_pieces(docs, model).collect())
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), library.decode(ids)))
    assert got == want


def test_pieces_of_odd_texts(model, library):
    import codecs

    codecs.register_error("one_each", pieces._one_each)
    r = random.Random(3)
    parts = ["a", "b", "th", "in", " ", "   ", "\n", "▁", "é", "漢", "😀", "\0", "aaaa", "----", "<s>", "ing", "\t"]
    odd = ["", " ", "▁", "a" * 3000, "ab" * 2000, "\n" * 50] + ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(500)]
    for t, b in zip(odd, pieces.encode_texts(model, odd, {}), strict=True):
        ids = np.frombuffer(b, dtype="<u4")
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert model.decode(ids) == library.decode(ids.tolist())


# 4


def test_jaccard_classes(spark, docs, texts):
    sets = {}
    for i, t in texts:
        w = words(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    link = {(a, b) for a in ids for b in ids if a != b and sets[a] and len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) >= 0.8}
    comp = {i: i for i in ids}
    for _ in ids:
        for a, b in link:
            comp[a] = min(comp[a], comp[b])
    want = [(i, min([j for j in ids if sets[j] == sets[i]], default=i) if sets[i] else i, sum(a == i for a, _ in link), comp[i], comp[i] == i) for i in ids]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.component_id, r.kept) for r in jaccard_classes_of(docs))
    assert got == want


def jaccard_classes_of(docs):
    return jaccard_forest.jaccard_classes(docs, block=4).collect()


def test_jaccard_prefixes_are_shortened_until_the_recall_is_met():
    f = jaccard_forest.estimated_recall
    few, weak, strong = [0] * 20, [500, *[0] * 19], [*[0] * 18, 5000, 5000]
    assert f(few, 8, 32, 0.8) < f(few, 7, 32, 0.8) < f(few, 6, 32, 0.8) < 1
    level = lambda found: next(x for x in range(8, 3, -1) if f(found, x, 32, 0.8) >= 0.99999 or x == 4)
    assert level(strong) > level(few) > level(weak) >= 4


def test_jaccard_pairs_are_met_once():
    rng = np.random.default_rng(3)
    held = [np.array([n for n in rng.permutation(40) if n % 4 != i % 3][:30]) for i in range(60)]
    order = rng.permutation(40)
    held = [np.array([n for n in order if n in set(h.tolist())]) for h in held]
    times = np.zeros((60, 60), dtype=int)
    for node in range(40):
        at = [i for i, h in enumerate(held) if node in h]
        times[np.ix_(at, at)] += jaccard_forest.first_in_common([held[i] for i in at], [held[i] for i in at], node) if at else 0
    assert (times == [[len(np.intersect1d(a, b)) > 0 for b in held] for a in held]).all()


def test_jaccard_forest_keeps_rows_with_company(spark):
    rng = np.random.default_rng(4)
    paths = [rng.integers(0, 3, size=(4, 6)).astype("<u2") for _ in range(80)]
    df = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(paths)], "i long, path binary")
    got = {(r.i, r.tree): r.deep for r in jaccard_forest._forest(df, 4, 6, 2, 3).collect()}
    for t in range(4):
        for i, p in enumerate(paths):
            deep = max(int(np.cumprod(p[t] == q[t]).sum()) for j, q in enumerate(paths) if j != i)
            # the ends of ranges are kept in any case
            assert got.get((i, t), 0) in (deep, 6) if deep >= 2 else got.get((i, t), 6) == 6
    assert sum(v == 6 for v in got.values()) < 320


def test_jaccard_recall_of_links_of_all_strengths(spark):
    """Pairs of every similarity from 0.8 up, and a large group of near copies."""
    r = random.Random(17)
    rows, want = [], set()
    for i in range(400):
        n = r.randint(30, 120)
        a = [f"p{i}x{k}" for k in range(n)]
        b = a[: r.randint(int(0.78 * n), n)] + [f"q{i}x{k}" for k in range(r.randint(0, int(0.2 * n)))]
        rows += [" ".join(a), " ".join(b)]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        if len(x & y) >= 0.8 * len(x | y):
            want |= {2 * i, 2 * i + 1}
    base = [f"g{k}" for k in range(200)]
    for i in range(300):
        ws = base[:]
        ws[r.randrange(200)] = f"edit{i}"
        rows.append(" ".join(ws))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x for x in jaccard_forest.jaccard_classes(df).collect()}
    found = {i for i in range(800) if got[i].n_links}
    assert found <= want and len(found) >= 0.99 * len(want) and len(want) > 200
    assert all(got[i].n_links == 299 and got[i].component_id == 800 for i in range(800, 1100))


def test_large_keys_beside_nulls(spark):
    big = [(1 << 60) + 1, (1 << 60) + 3, None, -(1 << 62) - 1]
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(k, t, "en", "s", 3) for k in big], SCHEMA).coalesce(1)
    some = sorted(k for k in big if k is not None)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_forest.jaccard_classes(df).where("doc_id is not null").collect()) == [(k, some[0]) for k in some]
    assert sorted(r.doc_id for r in long_repeats.repeated_words(df).where("doc_id is not null").collect()) == some
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: r.refers_to for r in warc.archive_round_trip(pages).collect()}
    assert got == {k: None if k == some[-1] else some[-1] for k in big}
    got = near_vectors.near_vectors(spark.createDataFrame([(k, [1.0, 2.0], 1) for k in big], "vec_id long, embedding array<double>, label int").coalesce(1))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.where("vec_id is not null").collect()) == [(k, 3, some[0]) for k in some]


def test_one_of_each_keeps_columns_and_null_keys(spark, clashing):
    out = jaccard_forest.one_of_each(clashing.unionByName(clashing.where("doc_id = 3")).unionByName(clashing.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))))
    assert out.columns == clashing.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(3) == 1 and ids.count(4) == 0 and ids.count(None) == 1


# 5


def test_licences(spark):
    rows = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. cc by", "Apache  License, Version 2.0", "gnu general\npublic license GNU GENERAL PUBLIC LICENSE", "omit licenses", "mit licenseé", None, "", "MIT, License x" * 50]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    for i, t in enumerate(rows):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at, labels = [], set()
        for phrase, label in licences.BASE.items():
            q = phrase.split()
            hits = [j for j in range(len(ws)) if ws[j : j + len(q)] == q]
            at += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[1].labels == "gpl,gpl-3.0" and got[2].labels == "cc-by,cc-by-nc-4.0" and got[3].labels == "apache,apache-2.0"
    assert len(licences.rules()) > 300


def test_licences_over_indented_and_commented_lines(spark):
    gaps = ["\n" + " " * 10, "\n *" + " " * 12, "\n" + "#" * 30 + "\n# ", " " * 3000]
    rows = [f"under the{g}GNU Lesser General{g}Public License{g}version{g}2.1" for g in gaps] + [f"Mozilla{g}Public License" for g in gaps]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert [got[i].labels for i in range(8)] == ["lgpl-2.1"] * 4 + ["mpl"] * 4
    wide, narrow = got[0].found[0], licences.detections(b"under the gnu lesser general public license version 2.1")
    assert (wide.first, wide.last) == (2, 9) and wide.rule == narrow[0][2].name


LICENCE_TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal\n * in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
    "bsd-3-clause": "Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "gpl-2.0-or-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-or-later": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-or-later": "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-sa-4.0": "<a href=https://creativecommons.org/licenses/by-sa/4.0/>",
    "cc-by": "You must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    "cc0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}


@pytest.mark.parametrize("label", LICENCE_TEXTS)
def test_licence_texts_and_notices(label):
    low = LICENCE_TEXTS[label].lower().encode()
    assert label in {r.label for _, _, r in licences.detections(low)}
    # the gate opens no less than trying all rules would
    assert {i for i, r in enumerate(licences.rules()) if r.pattern.search(low)} <= set(licences.opened(low))


def test_licence_suppression_like_a_plain_version():
    r = random.Random(3)
    phrases = [*LICENCE_TEXTS.values(), "GNU General Public License", "GPL version 3", "under the GPL v3", "MIT License", "licensed under the Apache License, Version 2.0", "CC BY-NC 4.0", "SPDX-License-Identifier: MIT", "BSD license", "and", "the", "x " * 9]
    for _ in range(40):
        low = " ".join(r.choice(phrases) for _ in range(r.randint(1, 25))).lower().encode()
        every = [(*m.span(), q) for q in licences.rules() for m in q.pattern.finditer(low)]
        kept = []
        for p in sorted({q.priority for _, _, q in every}, reverse=True):
            own = [x for x in every if x[2].priority == p]
            if p:
                own = [x for x in own if not any(a <= x[0] and x[1] <= b for a, b, _ in kept)]
                own = [x for x in own if not any(a <= x[0] and x[1] <= b and b - a > x[1] - x[0] for a, b, _ in own)]
            kept += own
        assert sorted((a, b, q.name) for a, b, q in kept) == sorted((a, b, q.name) for a, b, q in licences.detections(low))


def test_licences_of_long_and_repeated_texts(spark, none):
    import time

    low = b"mit license and gnu general public license version 3 " * 20000
    began = time.time()
    assert len(licences.detections(low)) == 80000 and time.time() - began < 3
    df = spark.createDataFrame([(1, low.decode()), (1, low.decode()), (None, "mit license")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_base, r.labels) for r in licences.scan_licences(df).collect())
    assert got == [("1", 40000, "gpl,gpl-3.0,mit")] * 2 + [("None", 1, "mit")]
    assert licences.scan_licences(none).collect() == []


# 6


def test_toxicity_learns_and_holds_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    out = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    held = out[out["held_out"]]
    r, pos = held["score"].rank().to_numpy(), held["toxic"].to_numpy() == 1
    auc = (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.85 and held[held["toxic"] == 0]["predicted"].mean() < 0.05


def test_toxicity_keeps_every_clear_feature(spark):
    r = random.Random(8)
    toxic = "".join(chr(0x4E00 + r.randrange(20000)) for _ in range(4000))
    clean = "".join(chr(0x4E00 + r.randrange(20000)) for _ in range(4000))
    df = spark.createDataFrame([(i, toxic if i % 2 else clean) for i in range(120)], "doc_id long, text string")
    weights, _ = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    has = [set(toxicity.features([t])[1].tolist()) for t in (toxic, clean)]
    clear = np.array(sorted(has[0] ^ has[1]))
    assert len(clear) > 20000 and (weights[clear] != 0).all() and np.count_nonzero(weights) == len(clear)
    # of one half that the classifier never saw alone
    out = toxicity.score_toxicity(df.select("doc_id", F.expr("substring(text, 2001, 60)").alias("text")), (weights, 0.0)).collect()
    assert all((x.toxicity > 0.5) == (x.doc_id % 2 == 1) for x in out)


def test_toxicity_is_fitted_alike_in_pieces():
    rng = np.random.default_rng(5)
    cols = [np.flatnonzero(rng.random(30) < rng.choice([0, 0.2])).astype(np.int32) for _ in range(200)]
    scale, y = rng.normal(size=30), (rng.random(200) < 0.3).astype(float)
    whole, parts = toxicity.logistic(cols, scale, y), toxicity.logistic(cols, scale, y, most=7)
    assert np.allclose(whole[0], parts[0], atol=1e-6) and whole[1] == pytest.approx(parts[1], abs=1e-6)
    x = np.zeros((200, 30))
    for i, c in enumerate(cols):
        x[i, c] = scale[c]
    e = 1 / (1 + np.exp(-(x @ whole[0] + whole[1]))) - y
    assert np.abs(x.T @ e + whole[0]).max() < 0.2 and abs(e.sum()) < 0.2


def test_toxicity_edges(spark, docs, none):
    labels = spark.createDataFrame([(None, 1), (3, None), (7, 5), (9, 1), (9, 0), (10, 0), (10, 0)], "doc_id long, toxic int")
    for l in (labels, labels.where("toxic > 9")):
        model = toxicity.fit(docs, l)
        assert all(0 <= r.toxicity <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    assert toxicity.score_toxicity(none, toxicity.fit(none, labels)).collect() == []


# 7


def test_order_minhash(spark, docs, texts, none):
    rows = {r.doc_id: r for r in order_minhash.fingerprints_with_edits(docs).collect()}
    for i, (k, t) in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)][1] or ""
        h = len(t) // 2
        r = rows[k]
        assert r.edited == t[: len(t) - h] + nxt[:h] and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == "") == (not words(t))
    by_text = collections.defaultdict(set)
    for k, t in texts:
        by_text[t or ""].add(rows[k].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert order_minhash.fingerprints_with_edits(none).collect() == []


def test_order_minhash_like_a_plain_version(spark):
    """Selection, numbering and order, recomputed in Python from Spark's own hashes."""
    text = "a b a b c a b d e a b c " * 9
    w = words(text)
    fp = spark.createDataFrame([(text,)], "t string").select(order_minhash.fingerprint(F.col("t")).alias("f")).first().f
    grams = [(i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    h = spark.createDataFrame(grams, "i long, x string, y string").select("i", F.shiftright(F.xxhash64("x", "y"), 30).alias("h")).collect()
    seen, numbered = collections.Counter(), []
    for r in sorted(h, key=lambda r: r.i):
        numbered.append((r.i, r.h, seen[r.h]))
        seen[r.h] += 1
    g = spark.createDataFrame(numbered, "i long, h long, o int").select("i", F.xxhash64("h", "o").alias("g")).collect()
    order = sorted(((r.g % 2**64) >> 59, ((r.g % 2**64) >> 31) % 2**28, r.i) for r in g)
    assert [x >> 32 for x in fp] == list(range(32))
    for b, x in enumerate(fp):
        at = next((n for n, o in enumerate(order) if o[0] >= b), 0)
        two = sorted((order[at], order[(at + 1) % len(order)]), key=lambda o: o[2])
        cols = [F.lit(o[0] << 28 | o[1]).cast("long") for o in two]
        assert spark.range(1).select(F.xxhash64(*cols).alias("z")).first().z % 2**32 == x % 2**32


@pytest.mark.parametrize("n", [10, 20, 40, 60])
def test_order_minhash_tells_order_in_short_texts(spark, n):
    w = [f"w{i}" for i in range(n)]
    blocks = [w[i : i + 5] for i in range(0, n, 5)]
    moved = [x for b in blocks[::-1] for x in b]
    near = w[:-1] + ["other"]
    f = [r.f for r in spark.createDataFrame([(0, " ".join(w)), (1, " ".join(moved)), (2, " ".join(near))], "i int, t string").orderBy("i").select(order_minhash.fingerprint(F.col("t")).alias("f")).collect()]
    like = [len(set(f[0]) & set(x)) / 32 for x in f]
    assert like[0] == 1 and like[1] < 0.7 and like[1] < like[2]


def test_order_minhash_likeness_falls_with_edits(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(500)}" for _ in range(600)]
    few, many, moved = base[:], base[:], base[300:] + base[:300]
    for i in range(0, 600, 100):
        few[i] = "zz"
    for i in range(0, 600, 3):
        many[i] = "zz"
    df = spark.createDataFrame([(" ".join(x),) for x in (base, few, many, moved)], "t string").select(order_minhash.fingerprint(F.col("t")).alias("f"))
    fs = [set(x.f) for x in df.collect()]
    like = [len(fs[0] & f) for f in fs]
    assert like[0] > like[1] > like[2] and like[1] > 16


def test_order_minhash_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, None), (1, "x y"), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited) for r in order_minhash.fingerprints_with_edits(df).collect())
    assert got == [(False, 1, 0, ""), (False, 1, 3, "x "), (False, 2, 0, ""), (True, 0, 5, "a b")]


# 8


def test_mixing(spark, docs, texts, none):
    got = {r.doc_id: r for r in mixing.mix_sources(docs, block=8, bucket=7).collect()}
    size = {i: len(words(t)) for i, t in texts}
    src = {i: ("s0", "s0", "s1", "s2", None)[i % 5] for i, _ in texts}
    names = sorted({s for s in src.values() if s}) + [None]
    n = {s: sum(size[i] for i in size if src[i] == s) for s in names}
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(n.values()), {}, list(names)
    while True:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] > 2 * n[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * n[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * w[s] for s in open_}
    for i in size:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], n[src[i]]) and r.target == pytest.approx(target[src[i]], abs=1e-5) and r.taken <= 2 * r.size
    for s in names:
        assert sum(got[i].taken for i in size if src[i] == s) == pytest.approx(target[s], abs=40)
    assert mixing.mix_sources(none).collect() == []
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(5), block=8, bucket=100).collect()}
    assert again == {i: r.taken for i, r in got.items()}


# 9


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/c", "x"), (2, "http://a.b/c", "x"), (3, None, None), (4, "HTTP://www.B.a:80/?q#f", ""), (5, "é", "é" * 5000), (6, "http://a.b/c\r\nX: y", "q\r\n\r\nz")] + [(100 + i, "http://h.ex/1", "same") for i in range(40)]
    got = {r.page_id: r for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", parts=3).collect()}
    best = {}
    for k, _, h in rows:
        best[h or ""] = max(best.get(h or "", 0), k)
    for k, _, h in rows:
        b = (h or "").encode()
        own = best[h or ""] == k
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else best[h or ""])
        assert not own or bytes(got[k].payload) == b


def test_warc_null_and_repeated_keys(spark):
    rows = [(None, "a", None), (None, "a", "x"), (7, "a", "x"), (7, "a", "x"), (7, "b", "y")]
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type) for r in warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("7", 1, "response")] * 3 + [("None", 0, "response"), ("None", 1, "revisit")]
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_index_has_blocks(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.ex/{i}", str(i)) for i in range(500)], "page_id long, url string, html string")
    captures = warc.write_archives(pages, folder)
    firsts, names = warc.build_index(captures, folder, 3, lines=16)
    reader = warc.Reader(folder, firsts, names)
    assert firsts == sorted(firsts) and len(names) == 3
    line = next(reader.lines("ex,h3)/10 10"))
    assert reader.record(line)[2] == b"10" and list(reader.lines("ex,h3)/10 11")) == []


# 10


def brute_repeats(texts, width=35):
    ws = {i: words(t) for i, t in texts}
    seen = collections.Counter(tuple(w[j : j + width]) for w in ws.values() for j in range(len(w) - width + 1))
    out = []
    for i, w in ws.items():
        dead = {k for j in range(len(w) - width + 1) if seen[tuple(w[j : j + width])] > 1 for k in range(j, j + width)}
        out.append((i, len(w), len(dead), sha(" ".join(x for k, x in enumerate(w) if k not in dead))))
    return sorted(out)


def test_long_repeats(spark, docs, texts):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in long_repeats.repeated_words(docs).collect())
    assert got == brute_repeats(texts)


def test_results_do_not_depend_on_partitions(spark, docs, texts):
    """More partitions than files that tables go to: some tasks work on several partitions."""
    many = docs.repartition(64)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in long_repeats.repeated_words(many).collect()) == brute_repeats(texts)
    for f in (jaccard_forest.jaccard_classes, mixing.mix_sources, mixing.mixed_documents, long_repeats.without_repeats, order_minhash.fingerprints_with_edits):
        assert sorted(map(repr, f(many).collect())) == sorted(map(repr, f(docs.coalesce(1)).collect()))


def test_long_repeats_of_periodic_texts(spark):
    r = random.Random(9)
    unit = ["a ", "b ", "a b ", "a a b ", "a b c d ", "x " * 36]
    rows = [(i, "".join(r.choice(unit) * r.randint(1, 40) for _ in range(r.randint(1, 4)))) for i in range(150)]
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in long_repeats.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_repeats(rows)


def test_long_repeats_amid_words_that_occur_once(spark):
    """Windows without an interior symbol, in texts that have such symbols, all of them unique."""
    lone = iter(f"u{i}" for i in range(100000))
    some = lambda n: [next(lone) for _ in range(n)]
    rows = [some(50) + ["z"] * 60 + some(50), some(60) + ["y"] * 36, ["x"] * 35 + some(40), some(80), some(40) + ["v"] * 20 + some(3) + ["v"] * 40]
    rows += [some(50) + ["q"] * 37 + some(50), some(50) + ["q"] * 36 + some(50)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows)
    assert [x[2] for x in want] == [60, 36, 0, 0, 40, 37, 36]
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in long_repeats.repeated_words(df).collect()) == want
    cut = {r.doc_id: sha(r.text) for r in long_repeats.without_repeats(df).collect()}
    assert cut == {x[0]: x[3] for x in want}


def test_long_repeats_null_and_repeated_keys(spark, none):
    p = " ".join(f"w{i}" for i in range(40))
    rows = [(None, p + " a"), (None, "b " + p), (1, p), (1, "other"), (1, "other"), (2, None)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in long_repeats.repeated_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", 1, 0), ("1", 1, 0), ("1", 40, 40), ("2", 0, 0), ("None", 41, 40), ("None", 41, 40)]
    assert long_repeats.repeated_words(none).collect() == []


# all


def test_oracles(spark, sf_dir, duck):
    for name, sql in registry.ORACLES.items():
        same_rows(registry.QUERIES[name](spark, sf_dir), duck, sql)


def test_operators_ignore_clashing_columns(spark, docs, clashing, model):
    for f in (jaccard_forest.jaccard_classes, long_repeats.repeated_words, mixing.mix_sources, order_minhash.fingerprints_with_edits, licences.scan_licences, lambda d: pieces.with_pieces(d, model)):
        assert sorted(map(repr, f(docs).collect())) == sorted(map(repr, f(clashing).collect()))


def test_operators_without_rows(spark, none, model):
    assert licences.scan_licences(none).collect() == [] and pieces.with_pieces(none, model).collect() == []
    assert jaccard_forest.jaccard_classes(none).collect() == [] and jaccard_forest.one_of_each(none).collect() == []
    assert long_repeats.without_repeats(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_pipeline_stages_with_clashing_columns(spark, docs, clashing, sf_dir):
    import corpus_pipeline as P

    for name, stage in P.STAGES[:-1]:
        plain, more = stage(spark, docs, sf_dir), stage(spark, clashing, sf_dir)
        assert more.columns == clashing.columns
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, more.select(docs.columns).collect()))


def test_mixed_documents_hold_what_the_mix_takes(spark, docs):
    mix = {r.doc_id: r for r in mixing.mix_sources(docs, block=8, bucket=7).collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(docs, block=8, bucket=7).collect():
        got[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == {i: r.taken for i, r in mix.items() if r.taken}


def test_pipeline_stages(spark, docs, sf_dir):
    import corpus_pipeline as P

    cols, at = docs.columns, docs
    for name, stage in P.STAGES:
        before, at = at, stage(spark, at, sf_dir).cache()
        assert at.count() <= 2 * before.count()
        if name != "token_ids":
            assert at.columns == cols
        if name == "near_duplicates":
            left = [r.doc_id for r in at.collect()]
            want = {r.doc_id for r in jaccard_forest.jaccard_classes(before).where("kept").collect()}
            assert set(left) == want and len(left) == len(want)
        if name == "long_repeats":
            cut = {r.doc_id: r for r in long_repeats.repeated_words(before).collect()}
            for r in at.collect():
                assert len(words(r.text)) == cut[r.doc_id].n_words - cut[r.doc_id].n_removed
    assert at.count() > 0


def test_pipeline_run_like_plain_python(spark, library, tmp_path):
    import math

    import corpus_pipeline as P

    r = random.Random(21)
    voc, bad = [f"word{i}" for i in range(300)], ["grolmix", "vexatrun", "zzyrk", "quombat"]
    line = lambda n: " ".join(r.choice(voc) for _ in range(n))
    passage, rows, toxic = line(45), [None, "", " \n "], set()
    for i in range(150):
        rows.append(line(r.randint(20, 150)))
        if i % 4 == 0:
            toxic.add(len(rows))
            rows.append(" ".join(r.choice(bad) if r.random() < 0.4 else r.choice(voc) for _ in range(60)))
        if i % 5 == 0:
            ws = rows[-1].split(" ") if len(rows) - 1 not in toxic else line(90).split(" ")
            rows.append(" ".join(ws))
            ws[len(ws) // 2] = "other"
            rows.append(" ".join(ws))
        if i % 6 == 0:
            rows.append(line(r.randint(0, 20)) + "\n" + passage + "  " + line(r.randint(0, 20)))
    lone = [" ".join(f"only{k}" for k in range(s, s + 50)) for s in (0, 50)]
    rows += [lone[0] + " " + "z " * 60 + lone[1], passage]
    source = {i: ("s0", "s0", "s1", "s2", None)[i % 5] for i in range(len(rows))}
    spark.createDataFrame([(i, t, "en", source[i], len(t or "")) for i, t in enumerate(rows)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # rejected ones, and one of each group
    text = {i: t for i, t in enumerate(rows) if i not in toxic}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in text.items()}
    comp = {i: i for i in text}
    links = [(a, b) for a in text for b in text if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while any(comp[a] != comp[b] for a, b in links):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    text = {i: t for i, t in text.items() if comp[i] == i}
    # cut texts
    ws = {i: words(t) for i, t in text.items()}
    seen = collections.Counter(tuple(w[j : j + 35]) for w in ws.values() for j in range(len(w) - 34))
    n_cut = 0
    for i, w in ws.items():
        dead = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        n_cut += bool(dead)
        text[i] = " ".join(x for k, x in enumerate(w) if k not in dead) if dead else text[i]
    # copies
    size = {i: len(words(t)) for i, t in text.items() if words(t)}
    names = sorted({source[i] for i in text if source[i]}) + [None]
    n = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(n.values()), {}, list(names)
    while full := [s for s in open_ if left / sum(w[x] for x in open_) * w[s] > 2 * n[s]]:
        for s in full:
            target[s] = 2.0 * n[s]
            open_.remove(s)
        left = 1.5 * sum(n.values()) - sum(target.values())
    target |= {s: left / sum(w[x] for x in open_) * w[s] for s in open_}
    all_ = sum(target.values())
    blocks, nth, plays = {s: max(1, math.ceil(n[s] / 64)) for s in names}, collections.Counter(), collections.Counter()
    for slot in range(math.ceil(round(all_) / 64)):
        u, up = (slot + 0.5) * mixing.GOLDEN % 1.0, 0.0
        for s in names:
            up += target[s] / all_
            if u < up:
                break
        plays[s, nth[s] % blocks[s]] += nth[s] < 2 * blocks[s]
        nth[s] += 1
    want, copies_of, place, n_part = [], {}, collections.Counter(), 0
    for i in sorted(size, key=lambda i: sha(str(i))):
        s, at = source[i], place[source[i]]
        place[s] += size[i]
        times = [plays[s, k // 64] for k in range(at, at + size[i])]
        copies_of[i] = max(times)
        for turn in range(1, copies_of[i] + 1):
            part = [x for x, m in zip(words(text[i]), times) if m >= turn]
            n_part += len(part) < size[i]
            t = " ".join(part) if len(part) < size[i] else text[i]
            ids = library.encode(t, add_bos=True, add_eos=True)
            want.append((i, len(ids), np.array(ids, dtype="<u4").tobytes(), sha(library.decode(ids))))
    assert n_cut > 10 and len(links) > 30 and toxic and n_part and set(copies_of.values()) >= {0, 1, 2}
    got = sorted((x.doc_id, x.n_tokens, bytes(x.ids), x.decoded_sha256) for x in P.run(spark, str(tmp_path)).collect())
    assert collections.Counter(x[0] for x in got) == {i: c for i, c in copies_of.items() if c}
    assert got == sorted(want)
