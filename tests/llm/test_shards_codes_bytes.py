"""Operators 11 to 13 against brute force, and their edge cases: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

import collections
import datetime
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import asof, byte_language, part_codes


# operator 11


@pytest.fixture(scope="module")
def net():
    return byte_language.Network.fresh(["de", "en", "fr"], np.random.default_rng(3))


def plain_values(net, window):
    """The network as it is written down: every filter at every place."""
    e = net.embed[window].astype(float)
    h = []
    for w, f, b in zip(byte_language.WIDTHS, net.filters, net.bias, strict=True):
        z = [sum(e[i + j] @ f[j] for j in range(w)) + b for i in range(len(window) - w + 1)]
        h.append(np.maximum(np.max(z, axis=0), 0))
    return np.concatenate(h) @ net.out + net.shift


def plain_prediction(net, text):
    data = (text or "").encode()
    starts = [0]
    while starts[-1] + byte_language.WINDOW < len(data):
        starts.append(starts[-1] + byte_language.STRIDE)
    parts = [data[s : s + byte_language.WINDOW] for s in starts]
    values = [plain_values(net, np.frombuffer(p.ljust(byte_language.WINDOW, b"\0"), np.uint8)) for p in parts]
    z = np.average(values, axis=0, weights=[max(len(p), 1) for p in parts])
    p = np.exp(z - z.max())
    return p / p.sum()


TEXTS = [None, "", "  .!", "a", "Straße", "x" * 255, "y" * 256, "z" * 257, "ab " * 400, "漢字" * 90, "one text", "one text", "\0\0a"]


def test_tables_give_what_the_filters_give(net):
    got = byte_language.text_values(net, pa.array(TEXTS))
    want = np.array([plain_prediction(net, t) for t in TEXTS])
    assert np.abs(got - want).max() < 1e-4
    sliced = byte_language.text_values(net, pa.array(["qq", *TEXTS])[1:])
    assert np.array_equal(got, sliced)


def test_every_run_of_bytes_is_in_a_window():
    for n in (0, 1, 3, 4, 255, 256, 257, 509, 510, 511, 2000):
        _, start, end = byte_language.cut(np.zeros(n, np.uint8), np.array([0]), np.array([n]))
        inside = [any(s <= i and i + 4 <= e for s, e in zip(start, end, strict=True)) for i in range(n - 3)]
        assert all(inside) and end[-1] == n and (np.diff(start) == byte_language.STRIDE).all()
        assert (end - start <= byte_language.WINDOW).all()


def test_gradients(net):
    rng = np.random.default_rng(5)
    x, y = rng.integers(97, 102, (4, byte_language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss, grads = net.step(x, y)
    for p, g in zip(net.weights(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, ends = p[i], []
        for h in (2e-3, -2e-3):
            p[i] = old + h
            ends.append(net.step(x, y)[0])
        p[i] = old
        assert abs((ends[0] - ends[1]) / 4e-3 - g[i]) < 0.05 * abs(g[i]) + 1e-3


def test_language_edges(spark, net):
    rows = [(i if i else None, t, "x", 1, 9.0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, first int, score double")
    got = byte_language.predict_language(docs, net).collect()
    assert [r["text"] for r in got] == TEXTS and got[0].asDict().keys() == {"doc_id", "text", "lang_pred", "first", "score"}
    for r in got:
        p = plain_prediction(net, r["text"])
        if any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == net.languages[p.argmax()] and abs(r["score"] - p.max()) < 1e-4
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert byte_language.predict_language(docs.where("false"), net).count() == 0
    nothing = byte_language.fit(docs.where("false").withColumn("lang", F.lit("en")))
    assert {(r["lang_pred"], r["score"]) for r in byte_language.predict_language(docs, nothing).collect()} == {("und", 0.0)}


def test_one_language_and_a_very_long_text(spark):
    text = "wort und " * 60_000
    docs = spark.createDataFrame([(1, text, "de"), (2, text, "de"), (None, "teaches nothing", "en"), (3, None, "fr"), (4, "no language", None), (5, "12", "es")], "doc_id long, text string, lang string")
    one = byte_language.fit(docs, steps=5)
    assert one.languages == ["de"]
    assert {(r["lang_pred"], r["score"]) for r in byte_language.predict_language(docs.where("doc_id in (1, 2)"), one).collect()} == {("de", 1.0)}


def test_held_out_languages(spark, sf_dir):
    got = byte_language.op11_byte_language(spark, sf_dir)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and r["lang"] is not None]
    assert len(judged) > 20 and sum(judged) >= 0.95 * len(judged)


# operator 12


def plain_codes(rows, parts, entries, rounds, scale):
    """Loops over every part and entry with Python's integers."""
    kept = {k: [int(np.floor(np.float64(x) * scale)) for x in v] for k, v in rows}
    width = len(next(iter(kept.values()))) // parts
    cut = {k: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for k, v in kept.items()}
    books = [[cut[k][p] for k in sorted(cut)[:entries]] for p in range(parts)]
    pick = lambda book, x: min(range(len(book)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(book[i], x, strict=True)), i))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for k in cut:
                own[pick(books[p], cut[k][p])].append(cut[k][p])
            books[p] = [tuple(sum(c) // len(own[i]) for c in zip(*own[i], strict=True)) if i in own else e for i, e in enumerate(books[p])]
    out = {}
    for k, x in cut.items():
        at = [pick(books[p], x[p]) for p in range(parts)]
        out[k] = "".join(f"{i:02x}" for i in at), sum(sum((a - b) ** 2 for a, b in zip(books[p][i], x[p], strict=True)) for p, i in enumerate(at))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def vectors_of(n, dim, seed):
    r = random.Random(seed)
    return [(100 - i, [np.float32(r.choice([r.gauss(0, 1), -0.5, 0.25])).item() for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("parts,dim,entries", [(4, 8, 7), (2, 2, 3), (16, 64, 64)])
def test_codes(spark, parts, dim, entries):
    rows = vectors_of(90, dim, dim)
    df = spark.createDataFrame(rows, "k long, v array<float>")
    want, sha = plain_codes(rows, parts, entries, 2, 256)
    for n in (1, 5):
        books = part_codes.fit(df.repartition(n), "k", "v", parts, entries)
        assert books.sha256() == sha
        got = part_codes.encode(df, "v", books)
        assert {r["k"]: (r["code"], r["error"]) for r in got.collect()} == want
    near = part_codes.decode(got, books).collect()
    assert all(abs(sum((np.floor(np.array(r["v"]) * 256) - (np.array(r["decoded"]) * 256 - 0.5)) ** 2) - r["error"]) < 1e-6 for r in near)


def test_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 4), (2, [0.5] * 4), (2, [0.5] * 4), (3, None), (0, [nan] * 4), (4, [0.5, None, 0.5, 0.5]), (5, [0.5, -inf, 0.5, 0.5]), (6, [1.0] * 8), (7, []), (-9, [1.0] * 3), (None, [-1e30, 1e30, 0.0, 0.0]), (8, [-0.001] * 4)]
    df = spark.createDataFrame([(k, v, 1, "c", "e", 0) for k, v in rows], "k long, v array<double>, block int, code string, error string, _coded int")
    books = part_codes.fit(df, "k", "v", 2)
    assert books.entries.shape == (2, 3, 2)  # keys 1, 2 and 8
    got = part_codes.encode(df, "v", books).collect()
    assert sorted((r["k"] or -1, r["code"]) for r in got) == [(-1, "0202"), (1, "0100"), (2, "0100"), (2, "0100"), (8, "0002")]
    assert set(got[0].asDict()) == {"k", "v", "block", "code", "error"}
    assert part_codes.fit(df.where("false"), "k", "v") is None and part_codes.fit(df.where("k is null"), "k", "v", 2) is None
    assert part_codes.encode(df.where("false"), "v", books).count() == 0
    opened = spark.createDataFrame([("0000",), (None,)], "code string")
    assert [r["decoded"] is None for r in part_codes.decode(opened, books).collect()] == [False, True]


def test_label_errors(spark, tmp_path):
    rows = [(k, (1, 2, None)[k % 3], [x * 0.1 for x in v]) for k, v in vectors_of(80, 16, 9)] + [(500, 1, None)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = part_codes.op12_part_codes(spark, str(tmp_path)).collect()
    total = collections.Counter()
    for r in got:
        total[r["vec_id"] % 3] += r["error"]
    assert len(got) == 80 and all(r["label_error"] == total[r["vec_id"] % 3] for r in got)
    spark.createDataFrame([], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert part_codes.op12_part_codes(spark, f"{tmp_path}/none").collect() == []


# operator 13


def plain_matches(left, right, tolerance):
    """Each left row against all right rows of its key; right: (by, t, rank, id)."""
    own = collections.defaultdict(list)
    for r in right:
        own[r[0]].append(r)
    out = {}
    for key, by, t in left:
        near = [r for r in own[by] if by is not None and t is not None and r[1] is not None and t - tolerance <= r[1] <= t]
        at = max((r[1] for r in near), default=None)
        tied = [r for r in near if r[1] == at]
        best = min(tied, key=lambda r: (r[2] is None, r[2] or 0, -r[3]), default=None)
        out[key] = (None, None, 0) if best is None else (best[3], t - at, len(tied))
    return out


@pytest.mark.parametrize("most,tolerance", [(3, 50), (3, 50_000_000), (64, 7_000_000_000), (4096, 240 * asof.HOUR), (8, 0)])
def test_asof(spark, most, tolerance):
    r = random.Random(most)
    when = lambda: r.choice([None, r.randrange(-tolerance * 3 - 9, tolerance * 9 + 90), r.randrange(30), r.randrange(10) * (tolerance + 1)])
    who = lambda: r.choice([None, 1, 1, 1, r.randrange(6)])
    left = [(i, who(), when()) for i in range(700)]
    right = [(who(), when(), r.choice([None, 1, 2]), i) for i in range(300)]
    right += [(b, t, p, i + 1000) for b, t, p, i in right[:80]]
    l = spark.createDataFrame([(*x, "l", 5) for x in left], "key long, by long, t long, id2 string, n_tied int")
    right_df = spark.createDataFrame([(*x, 1, 2) for x in right], "by long, t long, rank int, id long, chunk int, key int")
    first = [F.col("rank").isNull().alias("a"), F.col("rank").alias("b"), (-F.col("id")).alias("c")]
    got = asof.asof_join(l, right_df, "by", "t", first, ["id"], tolerance, most, shard_rows=100)
    assert got.columns == ["key", "by", "t", "id2", "lag", "n_tied", "id"]
    assert {x["key"]: (x["id"], x["lag"], x["n_tied"]) for x in got.collect()} == plain_matches(left, right, tolerance)
    assert got.count() == 700
    empty = asof.asof_join(l, right_df.where("false"), "by", "t", first, ["id"], tolerance, most)
    assert {(x["id"], x["lag"], x["n_tied"]) for x in empty.collect()} == {(None, None, 0)} and empty.count() == 700
    assert asof.asof_join(l.where("false"), right_df, "by", "t", first, ["id"], tolerance, most).count() == 0


def test_one_key_is_spread_over_chunks(spark):
    n = 20_000
    l = spark.range(n).select(F.col("id").alias("key"), F.lit(7).cast("long").alias("by"), (F.col("id") * 60_000_000).alias("t"))
    r = spark.range(n).select(F.lit(7).cast("long").alias("by"), (F.col("id") * 60_000_000 - 30_000_000).alias("t"), "id")
    width = asof.chunk_width(l, r, "by", "t", 240 * asof.HOUR, 1000)
    most = l.unionByName(r, True).groupBy(F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0]
    assert width == 8 * asof.HOUR and most <= 1000
    got = asof.asof_join(l, r, "by", "t", [F.col("id")], ["id"], 240 * asof.HOUR, 1000, 500)
    assert got.where("id = key and lag = 30000000 and n_tied = 1").count() == n


def test_times_do_not_depend_on_the_session_zone(spark):
    at = [datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(2024, 3, 10, 2, 30, 0, 1), datetime.datetime(2024, 3, 31, 1, 59, 59)]
    df = spark.createDataFrame([(x,) for x in at], "t timestamp_ntz")
    want = [(x - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1) for x in at]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in df.select(asof.micros(F.col("t"))).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_orders_of_clicks_edges(spark, tmp_path):
    t = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    odd = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 2 == 1)
    even = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 2 == 0)
    clicks = [(odd, t(9, 30), 1, "x"), (odd, t(9, 30), 1, "x"), (even, t(9, 30), 1, None), (None, t(9), 1, None), (None, None, None, None), (1000, None, 1, None), (1001, t(9), None, None)]
    spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long, sale_id string").write.parquet(f"{tmp_path}/clicks.parquet")
    sales = [(s, 1, tot, t(9), p) for s, tot, p in ((even, float("nan"), None), (even + 200, 1.005, 2), (None, float("inf"), 2), (even + 400, None, None))]
    spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int").write.parquet(f"{tmp_path}/sales.parquet")
    got = {r["click_id"]: r for r in asof.op13_asof_orders(spark, str(tmp_path)).collect()}
    n = sum(1 + (s is not None and zlib.crc32(str(s).encode()) % 3 != 0) for s, *_ in sales)
    assert len(got) == 5 and got[odd]["n_tied"] == got[even]["n_tied"] == got[None]["n_tied"] == n
    assert got[odd]["lag_us"] == 0 and got[even]["lag_us"] == 30 * 60_000_000 and got[even]["sale_id"] == even + 200
    assert [(got[i]["n_tied"], got[i]["sale_id"], got[i]["lag_us"]) for i in (1000, 1001)] == [(0, None, None)] * 2


# operators 2, 3 and 9: broken pages, two models in one process, captures that are missing


@pytest.mark.parametrize("make", [
    lambda n: "<a" * n + '"', lambda n: "<nav>x<main>y" * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<nav>" * n + "<p>w w</p>", lambda n: "<nav><div>" * n + "<h1>t</h1>",
    lambda n: "<li><p>" * n, lambda n: "<td><b>" * n, lambda n: '<a x="' * n, lambda n: "<script" * n + "'", lambda n: "<dt><ul><dd>" * n,
])
def test_broken_pages_take_time_in_proportion(make):
    import time

    from kindred.llm.main_text import main_text

    took = []
    for n in (4000, 32_000):
        took.append(float("inf"))
        for _ in range(2):
            began = time.process_time()
            main_text(make(n))
            took[-1] = min(took[-1], time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)


def test_formulas_stay_and_quotes_that_nothing_closes_end_with_the_tag():
    from kindred.llm.main_text import main_text

    words = "These words are the text of a page that goes on for a while and says a thing or two about the world. " * 3
    page = f"<article><p>{words}so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end of it.</p></article>"
    assert main_text(page).endswith("so x=2 end of it.")
    assert main_text(f"<article><p title='it is\">{words}</p></article>") == " ".join(words.split())


def plain_run(scores):
    """The best contiguous run by trying all: (score, from, to)."""
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best[0] + 1e-9:
                best = (sum(scores[i:j]), i, j)
    return best


def test_scan_finds_the_best_run():
    from kindred.llm import main_text as M

    r = random.Random(2)
    part = lambda: r.choice(["<p>", "</p>", "<div class='sidebar'>", "</div>", "<a href='x'>", "</a>", "<br>", "<ul><li>", "</ul>", "<article>", "</article>", "word " * r.randint(1, 30)])
    for _ in range(150):
        page = "".join(part() for _ in range(r.randint(1, 25)))
        doc, w = M.Page(page), M.weights()
        cues, prose = doc.blocks()
        out = [False] * len(doc.name)
        for e in range(1, len(out)):
            out[e] = out[doc.parent[e]] or w.unlikely(doc.features[e])
        scores = []
        for i, (kind, what, e) in enumerate(doc.tokens):
            if out[e]:
                scores.append(w.skip if kind == "<" and not out[doc.parent[e]] and what == doc.name[e] else 0.0)
            elif kind == "t":
                scores.append(len(what.split()) * w.of(M.features_at(doc.held[e], i in cues, i in prose)))
            else:
                scores.append(w.other if kind == "x" else 0.0 if i in prose else w.tag.get(what, w.other))
        score, i, j = plain_run(scores)
        words = [x for kind, what, e in doc.tokens[i:j] if kind == "t" and not out[e] for x in what.split()]
        got = M.main_text(page).split()
        assert got == words or abs(sum(scores[i:j]) - score) < 1e-9 and len(got) <= sum(kind == "t" for kind, *_ in doc.tokens) * 30 and _scores_equal(doc, scores, out, got, score)


def _scores_equal(doc, scores, out, got, score):
    """Another run of the same score gives these words."""
    n = len(scores)
    for i in range(n):
        for j in range(i + 1, n + 1):
            if abs(sum(scores[i:j]) - score) < 1e-9 and [x for kind, what, e in doc.tokens[i:j] if kind == "t" and not out[e] for x in what.split()] == got:
                return True
    return score < 1e-9 and not got


def test_two_models_in_one_process():
    from kindred.llm import pieces

    base = [("<unk>", 0.0, "unknown"), ("<s>", 0.0, "control"), ("</s>", 0.0, "control"), *[(f"<0x{i:02X}>", 0.0, "byte") for i in range(256)]]
    own = [("▁", -3.0, "normal"), ("a", -4.0, "normal"), ("b", -5.0, "normal"), ("▁a", -1.0, "normal"), ("ab", -2.0, "normal")]
    turned = [own[0], own[1], own[2], (own[4][0], -1.0, "normal"), (own[3][0], -2.0, "normal")]
    models = [pieces.PieceModel(*map(list, zip(*(base + x), strict=True)), 1, 2) for x in (own, turned)]
    pieces._known.clear()
    one = [pieces.encode_texts(m, ["ab ab"]) for m in models]
    alone = [pieces.encode_texts(m, ["ab ab"], {}) for m in models]
    assert one == alone and one[0] != one[1]


def test_a_missing_capture_raises(spark, tmp_path):
    from kindred.llm import warc

    pages = spark.createDataFrame([(i, f"http://h{i}.org/", "<p>x</p>") for i in range(3)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    firsts, names = warc.build_index(warc.write_archives(pages, folder), folder, 2)
    assert warc.read_archives(pages, folder, firsts, names, 2).count() == 3
    more = pages.unionByName(spark.createDataFrame([(7, "http://h1.org/", "")], pages.schema))
    with pytest.raises(Exception, match="no capture"):
        warc.read_archives(more, folder, firsts, names, 2).collect()
