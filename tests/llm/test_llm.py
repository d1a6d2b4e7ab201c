"""The training-data operators: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import bpe, chat, decontam, fingerprints, graph, html_text, langid, quality, queries, simhash, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, verdict string, fp long, ids string"


def odd_docs(spark):
    rows = [(1, None), (2, ""), (3, "   \n "), (4, "one"), (5, "two words"), (6, "x" * 50_000), (7, "a b c d e " * 3000), (8, "same text here now"), (8, "same text here now"), (9, "same text here now"), (None, "no id at all"), (10, "12 kg!")]
    return spark.createDataFrame([(i, t, "en", None, None, 0.5, "v", 1, "i") for i, t in rows], DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# --- 1

def weights(text):
    return {w: n * len(w) for w, n in Counter(w for w in re.split(r"[\x20\x09-\x0d]+", text.lower()) if w).items()}


def jaccard(a, b):
    keys = a.keys() | b.keys()
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / top if top else 1.0


def test_fingerprints_estimate_generalised_jaccard(spark):
    got = queries.op1_document_fingerprints(spark, SF).toPandas().sort_values("doc_id", ascending=False)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False)
    texts, errors = docs["text"].tolist(), []
    for i, r in enumerate(got.itertuples()):
        nxt = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + nxt[:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(r.near_edited - jaccard(weights(texts[i]), weights(edited)))
        errors.append(r.near_next - jaccard(weights(texts[i]), weights(nxt)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_equal_texts_have_equal_fingerprints(spark):
    df = odd_docs(spark).select(F.monotonically_increasing_id().alias("k"), "text")
    sigs = fingerprints.fingerprint(df.select("k", fingerprints.words_of(F.col("text")).alias("w")), ["k"], "w")
    got = sigs.join(df, "k").select("text", fingerprints.as_text(F.col("sig")).alias("s")).collect()
    same = {r["s"] for r in got if r["text"] == "same text here now"}
    none = {r["s"] for r in got if not (r["text"] or "").strip()}
    assert len(got) == 12 and len(same) == 1 and none == {"f" * 8 * fingerprints.DRAWS}


def test_fingerprints_of_a_dominant_word(spark):
    """Weight in one word counts as weight, shared or not, as every term draws in every sample."""
    rows, exact = [], []
    for k in range(20):
        shared = f"heavy{k} " * 1000
        a, b = (shared + " ".join(f"{side}{k}x{i}" for i in range(60)) for side in "ab")
        c, d = (f"{side}eavy{k} " * 1000 + " ".join(f"s{k}x{i}" for i in range(60)) for side in "cd")
        rows += [(4 * k + j, t) for j, t in enumerate((a, b, c, d))]
        exact += [jaccard(weights(a), weights(b)), jaccard(weights(c), weights(d))]
    df = spark.createDataFrame(rows, "k long, text string").repartition(4, "k")
    sigs = fingerprints.fingerprint(df.select("k", fingerprints.words_of(F.col("text")).alias("w")), ["k"], "w").withColumn("pair", F.floor(F.col("k") / 2))
    both = sigs.groupBy("pair").agg(F.min_by("sig", "k").alias("x"), F.max_by("sig", "k").alias("y"))
    got = [r[0] for r in both.orderBy("pair").select(fingerprints.likeness(F.col("x"), F.col("y"))).collect()]
    errors = np.array(got) - np.array(exact)
    assert abs(errors[::2].mean()) < 0.03 and abs(errors[1::2].mean()) < 0.03 and np.abs(errors).max() < 0.2


@pytest.mark.parametrize("least", [1, 2, 1000])
def test_neighbours_wrap_around(spark, least):
    ids = [3, 50, 7, 1000, 999, 8, 2, 1]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["id"]: r["next"] for r in fingerprints.with_neighbours(df, "doc_id", "text", least).where("ghost = 0").collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1], strict=True)}
    assert fingerprints.with_neighbours(empty(spark), "doc_id", "text").count() == 0
    assert fingerprints.with_neighbours(odd_docs(spark), "doc_id", "text").where("ghost = 0").count() == 12


def test_neighbour_ranges_do_not_follow_id_values(spark):
    """An outlier id, or an id of many rows, leaves ranges of bounded size, and the order is whole."""
    rows = [(i, f"t{i}") for i in range(900)] + [(10**12, "far")] + [(950, f"hot{i}") for i in range(600)] + [(None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints.with_neighbours(df, "doc_id", "text", 32).cache()
    sizes = [r[0] for r in found.where("ghost = 0").groupBy("bucket").count().select("count").collect()]
    assert len(sizes) > 20 and max(sizes) < 150
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    down = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))]
    assert {r["text"]: r["next"] for r in found.where("ghost = 0").collect()} == dict(zip(down, down[1:] + down[:1], strict=True))
    found.unpersist()


# --- 2

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a> <a href=/b>B</a></nav>
<div class="cookie-notice">We use cookies, please accept</div><div id=wrap><div class="content"><h2>Title &amp; x</h2><p>First   para with
<a href=x>link</a> and text enough to count for this small test page.</p><p>Second para, with more words in it.<br>after</p><script>var a="</p>";</script>
<form><input><label>Name</label></form><div class="comments"><p>A reader says a lot of things here, in many words.</p></div></div>
<div class=sidebar><p>side text</p></div></div><footer>foot</footer></body></html>"""


def test_html_main_text():
    want = "Title & x\nFirst para with link and text enough to count for this small test page.\nSecond para, with more words in it. after"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav><a>x</a></nav>") == ""
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


LONG = "<p>" + "A long paragraph with enough words to count as article text on this page. " * 4 + "</p>"


@pytest.mark.parametrize("wrap", [
    '<div class="layout has-sidebar">%s</div>', '<div class="no-comments">%s</div>', '<div class="content with-banner">%s</div>', '<div class="search-result-article">%s</div>',
    '<div class="legal-analysis">%s</div>', '<div class="post social-policy">%s</div>', '<div class="popular-science">%s</div>', "<form>%s</form>", '<div class="sidebar">%s</div>',
    '<div class="overflow-hidden" data-title="A hidden gem" data-id="comment">%s</div>', '<div style="visibility:hidden">%s</div>', '<main class="comments">%s</main>', '<aside><article>%s</article></aside>',
])
def test_html_marks_never_empty_a_page(wrap):
    page = "<body><ul><li><a href=1>Home</a><li><a href=2>Two</a></ul>" + wrap % ("<h1>Title</h1>" + LONG * 3) + "<div>Buy now</div><footer>(c) someone</footer></body>"
    assert html_text.main_text(page).split("\n") == ["Title", *[LONG[3:-5]] * 3]


def test_html_articles():
    parts = [f"<article><h2>{c}</h2>{LONG * n}</article>" for c, n in (("A", 1), ("B", 3), ("C", 2))]
    assert [b for b in html_text.main_text(f"<body><main>{''.join(parts)}</main><div>Buy now</div></body>").split("\n") if len(b) == 1] == ["A", "B", "C"]
    card = "<p>" + "Quote longer text. " * 60 + "</p>"
    refs = "<ul><li><a href=1>Ref one</a><li><a href=2>Ref two</a></ul>"
    got = html_text.main_text(f"<body><article><h1>T</h1><p>Lead.</p>bare<article class=card>{card}</article>{LONG * 2}{refs}<div class=comments>{LONG}</div></article><div>Buy now</div></body>").split("\n")
    assert [b[:7] for b in got] == ["T", "Lead.", "bare", "Quote l", "A long ", "A long ", "Ref one", "Ref two"]


def test_html_density_alone_finds_the_article(spark):
    """With all names and telling elements taken away the same text comes out, but for the shortest pages."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    bare = [re.sub(r"(</?)(article|footer|nav)", r"\1div", p).replace(' class="ad"', "") for p in pages]
    assert np.mean([html_text.main_text(a) == html_text.main_text(b) for a, b in zip(pages, bare, strict=True)]) >= 0.95


def brute_density(node, ratio):
    """Composite text density straight from the tree, recursively."""
    def walk(n, linked):
        linked = linked or n.tag == "a"
        own = sum(len("".join(x.split())) for x in n.children if isinstance(x, str))
        c, t, lc, lt = own, 0, own if linked else 0, 0
        for x in n.children:
            if not isinstance(x, str):
                a, b, d, e = walk(x, linked)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x.tag == "a")
        return c, t, lc, lt
    linked, up = False, node.parent
    while up is not None:
        linked, up = linked or up.tag == "a", up.parent
    c, t, lc, lt = walk(node, linked)
    if ratio is None:
        return lc / c if c else 0.0
    if not c:
        return 0.0
    base = np.log(c / max(c - lc, 1) * lc + ratio * c + np.e)
    return c / max(t, 1) * np.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / np.log(max(base, 1.0001))


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.sampled_from(["word ", "some more words here ", "x"]), lambda kids: st.tuples(st.sampled_from(["div", "a", "section"]), st.lists(kids, max_size=4)).map(lambda n: f"<{n[0]}>{''.join(n[1])}</{n[0]}>"), max_leaves=20))
def test_html_densities_equal_brute_force(page):
    root = html_text.parse(page)
    nodes = html_text._measure(root)
    ratio = brute_density(root, None)
    for n in nodes:
        assert n.density == pytest.approx(brute_density(n, ratio))
        assert n.total == pytest.approx(sum(brute_density(x, ratio) for x in n.children if not isinstance(x, str)))
    assert root.best.total == max(n.total for n in nodes)


def test_html_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, PAGE, "u"), (3, PAGE, "u"), (None, LONG * 300, "u")], "page_id long, html string, main_text string")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and sorted(len(r["main_text"]) for r in got)[:2] == [0, 0] and html_text.extract(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet='<>/"=&; abpdivul!-', max_size=80))
def test_html_never_fails(text):
    html_text.main_text(text)


def test_html_query(spark):
    got = queries.op2_html_extraction(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and (got["n_chars"] == got["text"].str.len()).all()
    assert not got["text"].str.contains("track(", regex=False).any()


# --- 3

def test_language_held_out(spark):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(truth, on="doc_id")
    held = m[m.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [("en", "the cat and the dog the cat"), ("de", "der hund und der die katze der hund")] * 5
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"), folds=100, held=99)
    got = langid.predict(odd_docs(spark), model).select("doc_id", "text", "__lang.*").collect()
    assert len(got) == 12 and {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    assert model.predict("12 34 !!") == ("und", 0.0) and model.predict("hunde")[0] == "de"
    assert all(model.predict(t) == ("und", 0.0) for t in ("²", "½ ²", "①", "Ⅷ", None, ""))
    assert langid.Model([], []).predict("text") == ("und", 0.0)
    assert langid.predict(empty(spark), model).count() == 0 and langid.fit(empty(spark)).langs == []


# --- 4

def test_chat_round_trip_and_sql(spark):
    from compare import differs, duck

    got = queries.op4_chat_formatting(spark, SF).drop("formatted_chars").toPandas()
    assert differs(got, duck(SF).execute(queries._OP4_SQL).df()) == ""


def price(window):
    """The operator's own estimate for a formatted window of texts without control strings."""
    return sum(-(-len(p.split("\n", 1)[1]) // 4) + 4 for p in window["formatted"].split("<|im_end|>\n")[:-1])


def test_chat_budget_with_long_system_and_long_turns(spark):
    rng = random.Random(8)
    rows = [(1, 0, "system", "s" * 6000)] + [(1, i, "user" if i % 2 else "assistant", "w" * 3500) for i in range(1, 12)]
    rows += [(2, 0, "system", "s" * 400)] + [(2, i, "user" if i % 2 else "assistant", "w" * rng.choice([4, 40, 400, 2500, 5000])) for i in range(1, 900)]
    rows += [(3, i, "user" if i % 2 else "assistant", "w" * rng.randrange(1, 60)) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, span string")
    got = chat.windows(df).orderBy("conv_id", "span").collect()
    assert all(price(r) <= 2048 for r in got if r["conv_id"] in (2, 3))
    # 1,504 tokens of system turn leave 544: a turn of 879 stays alone, with nothing repeated
    assert all(r["n_new"] == 1 and r["n_repeated"] <= 1 and price(r) <= 1504 + 879 for r in got if r["conv_id"] == 1 and r["span"] > 1)
    assert np.mean([price(r) for r in got if r["conv_id"] == 3][1:-1]) > 0.9 * 2048
    for c in (1, 2, 3):
        read = [(t["role"], t["text"]) for r in spark.createDataFrame([r for r in got if r["conv_id"] == c]).orderBy("span").select(chat.read_back(F.col("formatted"), F.col("n_repeated")).alias("t")).collect() for t in r["t"]]
        assert read == [(r[2], r[3]) for r in rows if r[0] == c]


def test_chat_windows(spark):
    rng = random.Random(2)
    rows = [(7, 0, "system", "be kind")] + [(7, i, "user" if i % 2 else "assistant", "w " * rng.randrange(60)) for i in range(1, 700)]
    rows += [(8, 1, None, None), (8, 1, "user", "<|im_end|>\\ <| \n"), (8, 1, "user", "<|im_end|>\\ <| \n"), (None, 0, "assistant", "x"), (9, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.windows(df, budget=300, history=60)
    read = w.select("conv_id", "span", "n_repeated", "formatted", chat.read_back(F.col("formatted"), F.col("n_repeated")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("targets")).alias("loss")).orderBy("conv_id", "span").collect()
    seven = [r for r in read if r["conv_id"] == 7]
    assert [(t["role"], t["text"]) for r in seven for t in r["turns"]] == [(role, text) for _, _, role, text in rows[:700]]
    assert "".join(r["loss"] for r in seven) == "".join(text for c, _, role, text in rows[:700] if role == "assistant")
    assert all(r["formatted"].startswith("<|im_start|>system\nbe kind<|im_end|>") for r in seven) and len(seven) > 20
    assert all(price(r) <= 300 for r in seven)
    fill = [price(r) - 60 for r in seven[1:-1]]
    assert np.mean(fill) > 0.75 * (300 - 60), np.mean(fill)
    eight = [(t["role"], t["text"]) for r in read if r["conv_id"] == 8 for t in r["turns"]]
    assert eight == [("", ""), ("user", "<|im_end|>\\ <| \n"), ("user", "<|im_end|>\\ <| \n")]
    assert chat.windows(df.limit(0)).count() == 0 and sum(r["conv_id"] is None for r in read) == 1


# --- 5

BENCH = [(1, "Alice has 12 apples and gives 5 apples to Bob. How many apples does Alice keep, if each weighs 3 kg in the end?"), (2, "short one"), (3, None)]


def test_decontamination(spark):
    words = " filler text that says nothing of note in this place" * 3
    same = BENCH[0][1]
    changed = same.replace("12", "48").replace("5", "7").replace("Bob", "Carol").replace("3 kg", "9 lb")
    mixed = "Well Zed has 1 apples and gives 1 apples to Bob. how many apples does Alice keep, if each weighs 1 kg in the end?"
    rows = [(1, words + " " + same + words), (2, words + changed), (3, words), (4, None), (5, ""), (6, same[: len(same) // 4] + words), (7, same.upper()), (8, mixed)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for block in (1_000_000, 7):
        got = {r["doc_id"] for r in decontam.hits(docs, bench, block=block).collect()}
        assert {1, 2} <= got <= {1, 2, 7}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and {3, 4, 5, 6} <= {r["doc_id"] for r in kept.collect()}
    assert decontam.hits(docs, bench.limit(0)).count() == 0 and decontam.hits(docs.limit(0), bench).count() == 0


def contained(item, doc):
    """Brute force over both texts: the share of the item that one place of the document covers."""
    tokens = decontam.Tokens()
    n, own = decontam.template_windows(item, tokens)
    _, other = decontam.template_windows(doc, tokens, np.unique(np.array([w[0] for w in own], dtype=np.int64)), frozenset([n] if n < decontam.WIDTH else []))
    met = [(pos, bpos, [(b[1], d[1]) for b, d in zip(bs, ds, strict=True)]) for h, pos, ds in other for g, bpos, bs in own if g == h]
    best = 0
    for lowest in {p - b for p, b, _ in met}:
        found = {}
        for p, b, s in met:
            if lowest <= p - b <= lowest + n:
                found.setdefault(p - b, []).append((b, s))
        there, back, covered = {}, {}, set()
        for group in sorted(found.values(), key=len, reverse=True):
            pairs = {x for _, s in group for x in s}
            clash = any(b == c and d != e or b != c and d == e for b, d in pairs for c, e in [*pairs, *there.items()])
            if not clash:
                there.update(pairs)
                covered |= {t for b, _ in group for t in range(b, b + min(n, decontam.WIDTH))}
        best = max(best, len(covered))
    return best / n if n else 0.0


FILL = "Some words come first and say nothing at all here. "
TOM = "Tom has 12 red apples in a big bag and his sister owns 40 green pears in a small box"
TRAIN = "The train leaves at 12:30 and the other train arrives at 11:30 on that day"
SHORT = "Alice bought 5 apples. Bob sold 3 pears. Carol ate 2 plums. Dave kept 9 figs."
SUM = "What is the sum of 12, 45, 78, 33, 91, 20, 64, 17?"


@pytest.mark.parametrize(("item", "doc", "found"), [
    ("Compute 12 + 35 * 7 - 4 + 19 * 88 - 3", FILL + "compute 12 + 35 * 7 - 4 + 19 * 88 - 3 " + FILL, True),
    (SHORT, FILL + "Zoe bought 7 apples. Max sold 4 pears. Tim ate 8 plums. Liz kept 6 figs." + FILL, True),
    (SUM, "What is the sum of 3, 4?", False), (SUM, "What is the sum of 3 and 4?", False), (SUM, SUM, True),
    (TRAIN, FILL + TRAIN.replace("12:30", "10:15").replace("11:30", "10:45"), True),
    (TRAIN, FILL + TRAIN.replace("12:30", "10:15").replace("11:30", "10:15"), False),
    (TOM, TOM.replace("12", "9").replace("40", "8").replace("and his", "and then later on his"), True),
    (TOM, TOM.replace("12", "9").replace("40", "9").replace("and his", "and then later on his"), False),
    (TOM, "A box. " * 400 + "Tom has 12 red apples in a box." + " Much later. " * 400 + "his sister owns 40 green pears", False),
    ("What is 2 + 2", FILL + "what is 2 + 2? " + FILL, True), ("Solve 3 x + 5 = 11", FILL + "Solve 3 x + 5 = 11.", True),
    ("short one", "a short one", False), ("short one", "Short one", True), ("", "", False), ("...", "...", False),
])
def test_decontamination_of(spark, item, doc, found):
    docs, bench = spark.createDataFrame([(1, doc), (None, doc), (2, FILL)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.hits(docs, bench).collect()} == ({1, None} if found else set())
    assert (contained(item, doc) >= decontam.SHARE) == found
    assert decontam.clean(docs, bench).count() == (1 if found else 3)


def test_decontamination_judges_rows_of_one_id_alone(spark):
    half = len(TOM) // 2
    docs = spark.createDataFrame([(1, TOM[:half]), (1, TOM[half:]), (1, TOM), (1, FILL)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, TOM)], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.hits(docs, bench).collect()] == [1] and decontam.clean(docs, bench).where(F.col("text") == FILL).count() == 1
    assert decontam.hits(docs.where("text != '" + TOM + "'"), bench).count() == 0


def test_windows_are_looked_up_by_a_table_that_loses_none():
    """Few windows reach the search in the sorted hashes, and those found are all; the ASCII pattern finds the same tokens (op5)."""
    rng = np.random.default_rng(5)
    hashes = rng.integers(-(1 << 63), 1 << 63, 60_000, dtype=np.int64)
    for n in (1, 9_000):
        own, seen = np.unique(hashes[:n]), decontam.Wanted(np.unique(hashes[:n]))
        assert seen.places(hashes.view(np.uint64)).tolist() == np.flatnonzero(np.isin(hashes, own)).tolist()
        assert seen.table[hashes.view(np.uint64) >> seen.shift].sum() < n + 60_000 / 8
    for text in (TOM, TRAIN, SHORT, "x_1.2.3,4:5/6.7. a\n!?12.:3 A1b2", "".join(map(chr, range(128)))):
        assert decontam._ASCII.findall(text) == decontam._TOKEN.findall(text)


def test_decontamination_query_equals_brute_force(spark):
    got = queries.op5_benchmark_decontamination(spark, SF).toPandas().set_index("doc_id")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect():
        share = max(contained(text, r["text"] or "") for _, text in items)
        assert got.loc[r["doc_id"], "contaminated"] == (share >= decontam.SHARE), r["doc_id"]


def test_decontamination_finds_whole_items(spark):
    got = queries.op5_benchmark_decontamination(spark, SF).toPandas().set_index("doc_id")
    norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in docs:
        if any(i in norm(r["text"]) for i in items):
            assert got.loc[r["doc_id"], "contaminated"]


# --- 6

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_quality_classifier(spark, sf).toPandas()
    m = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = m[m.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_quality_odd_rows_and_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 7] < 0.7)).astype(float)
    model = quality.train(x, y)
    stats = spark.createDataFrame(pd.DataFrame(x, columns=list(quality.STATISTICS))).select(F.struct(*quality.STATISTICS).alias("__stats"))
    got = np.array([r[0] for r in stats.select(model.score()).collect()])
    direct = 1 / (1 + np.exp(-(model.shift + sum(w * r.holds(x) for w, r in model.rules))))
    assert np.allclose(got, direct) and ((got > 0.5) == (y > 0)).mean() > 0.95 and 0 < len(model.rules) < 120
    scored = quality.score(odd_docs(spark), model).collect()
    assert len(scored) == 12 and all(0 <= r["__quality"] <= 1 for r in scored)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(odd_docs(spark), quality.fit(odd_docs(spark), none)).count() == 12


# --- 7

def brute_groups(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("pairs_up_to", "crowd"), [(16, 20000), (2, 20000), (2, 3)])
def test_links_connect_as_all_pairs_do(spark, pairs_up_to, crowd):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd, pairs_up_to).collect()
    at = {x: i for i, x in enumerate(fps)}
    assert all(bin((r["x"] ^ r["y"]) & (2**64 - 1)).count("1") <= 3 for r in got)
    comp = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([(at[r["x"]], at[r["y"]]) for r in got], "x long, y long")).collect()}
    assert [comp.get(i, i) for i in range(len(fps))] == brute_groups(fps)


def test_simhash_of_a_text():
    words = "The cat AND the cat and the cat".encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(6)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 6)
    assert simhash.simhash("The cat AND the cat and the cat") & (2**64 - 1) == want
    assert simhash.simhash(" \t\n") == 0 and simhash.simhash("ab") & (2**64 - 1) == xxhash.xxh64_intdigest(b"ab", 42)


def test_groups_of_odd_rows(spark):
    got = simhash.groups(odd_docs(spark)).collect()
    assert len(got) == 12 and {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in got if r["doc_id"] in (8, 9)} == {8}
    kept = simhash.keep_one(odd_docs(spark))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 10] and kept.columns == odd_docs(spark).columns
    assert simhash.groups(empty(spark)).count() == 0


@lru_cache(maxsize=None)
def shingles(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def shingle_jaccard(a, b, n=5):
    x, y = shingles(a, n), shingles(b, n)
    return len(x & y) / len(x | y)


def edited_families(rng, families=110, copies=6):
    out = []
    for f in range(families):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 150, 400]))]
        out.append(" ".join(words))
        for _ in range(copies - 1):
            own = list(words)
            for _ in range(rng.randrange(0, max(3, len(words) // 30))):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("pairs_up_to", "crowd"), [(16, 20000), (2, 20000), (1, 3)])
def test_wide_links_find_five_word_similarity(spark, pairs_up_to, crowd):
    texts = sorted(set(edited_families(random.Random(5))))
    rows = simhash.wide_fingerprints(spark.createDataFrame(list(enumerate(texts)), "fp long, text string")).select("fp", "sig.*")
    edges = simhash.wide_links(rows, crowd=crowd, pairs_up_to=pairs_up_to)
    got = {tuple(sorted((r["x"], r["y"]))) for r in simhash.verified_links(edges, spark.createDataFrame(list(enumerate(texts)), "fp long, text string")).collect()}
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if shingle_jaccard(texts[i], texts[j]) >= 0.8}
    comp = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*got, (0, 0)], "x long, y long")).collect()}
    joined = [comp.get(i, i) == comp.get(j, j) for i, j in near]
    assert len(near) >= 300 and np.mean(joined) >= 0.9
    assert all(shingle_jaccard(texts[i], texts[j]) >= 0.8 for i, j in got)


def test_a_far_link_is_found_behind_near_candidates_that_fail(spark):
    """Forty texts on one key: the nearest of each are unlike it, its only like one is the farthest."""
    n = 40
    index = [0] * simhash.WIDE.index_lanes
    # 0 and 1 are alike and 94 bits apart; the others, 89 from both and some 74 from each other, lie between them
    ends = {0: [0] * 8, 1: [-1, (1 << 30) - 1, *[0] * 6]}
    rng = random.Random(1)
    mids = {i: [(1 << 47) - 1, 0, *(sum(1 << b for b in rng.sample(range(60), 7)) for _ in range(6))] for i in range(2, n)}
    own = {i: " ".join(f"t{i}w{j}" for j in range(30)) for i in range(n)}
    own[1] = own[0] + " more"
    distinct = spark.createDataFrame([(i, *index, *(ends | mids)[i]) for i in range(n)], "fp long, " + ", ".join(f"{c} long" for c in simhash.WIDE.columns))
    texts = spark.createDataFrame(list(own.items()), "fp long, text string")
    once = simhash.verified_links(simhash.wide_links(distinct), texts)
    assert once.where("x = 0 and y = 1").count() == 0
    for tiers in ({"each": 2}, {"crowd": 10}):
        label = {r["fp"]: r["label"] for r in simhash.wide_classes(distinct, texts, **tiers).collect()}
        assert label == {i: 0 if i == 1 else i for i in range(n)}


def test_pairs_of_several_keys_are_listed_and_verified_once(spark, monkeypatch):
    """Members of many crowded keys: a pair between classes comes from one group, and a set travels once to a block (pipeline)."""
    rng, n, listed = random.Random(4), 40, []
    index = [0, 0, 0, 0]
    rows = [(i, *index[:3], rng.choice([0, 1 << 3, 1 << 40]), *(sum(1 << b for b in rng.sample(range(63), 4)) for _ in range(8))) for i in range(n)]
    words = [f"w{j}" for j in range(60)]
    own = {i: " ".join(words if i % 13 == 5 else [f"t{i}w{j}" for j in range(30)]) + f" x{i}" for i in range(n)}
    distinct = spark.createDataFrame(rows, "fp long, " + ", ".join(f"{c} long" for c in simhash.WIDE.columns))
    texts = spark.createDataFrame(list(own.items()), "fp long, text string")
    exact = simhash._exact
    monkeypatch.setattr(simhash, "_exact", lambda pairs, *rest: listed.append(sorted((r["x"], r["y"]) for r in pairs.collect())) or exact(pairs, *rest))
    monkeypatch.setattr(simhash, "SETS", 300)  # about ten sets: a family of several blocks
    label = {r["fp"]: r["label"] for r in simhash.wide_classes(distinct, texts, crowd=20).collect()}
    assert label == {i: 5 if i % 13 == 5 else i for i in range(n)}
    found = [p for part in listed for p in part]
    assert len(found) == len(set(found)) and set(found) | set(itertools.combinations((5, 18, 31), 2)) >= set(itertools.combinations(range(n), 2))


def rows_joined(spark, since, on):
    """Rows that joins on these keys made in the queries after ``since`` (the number of queries)."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    for i in range(since, store.executionsCount()):
        run = store.executionsList(i, 1).apply(0).executionId()
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(n) for n in range(nodes.size())):
            if "Join" in node.name() and re.search(rf"\[{on}#\d+L?\], \[{on}#\d+L?\], Inner", node.desc()):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_crowded_members_are_joined_by_fingerprint(spark):
    """Sixty texts that share every key, all unlike: lanes and labels are joined with the texts, not with 64 memberships of each (pipeline)."""
    n, rng = 60, random.Random(3)
    rows = [(i, *[0] * 4, *(sum(1 << b for b in rng.sample(range(63), 4)) for _ in range(8))) for i in range(n)]
    distinct = spark.createDataFrame(rows, "fp long, " + ", ".join(f"{c} long" for c in simhash.WIDE.columns))
    texts = spark.createDataFrame([(i, " ".join(f"t{i}w{j}" for j in range(30))) for i in range(n)], "fp long, text string")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    label = {r["fp"]: r["label"] for r in simhash.wide_classes(distinct, texts).collect()}
    assert label == {i: i for i in range(n)}
    assert 2 * n <= rows_joined(spark, before, "fp") < 64 * n


def test_a_family_of_many_pairs_is_verified_in_blocks(spark, monkeypatch):
    """Thirty short texts, every two of them a candidate: no task takes all 435 pairs, and the links are the same (pipeline)."""
    n, most = 30, []
    own = {i: f"x{i % 10} " + " ".join(f"w{i % 10}v{j}" for j in range(20)) + " end" * (i // 10) for i in range(n)}
    texts = spark.createDataFrame(list(own.items()), "fp long, text string")
    pairs = spark.createDataFrame(list(itertools.combinations(range(n), 2)), "x long, y long")
    cut = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: most.append(df.groupBy("home", "i", "j").count().agg(F.max("count")).first()[0]) or cut(df) if "j" in df.columns else cut(df))
    for bound in (10_000, 50):
        monkeypatch.setattr(simhash, "VERIFIED", bound)
        got = {(r["x"], r["y"]) for r in simhash._exact(pairs, texts, simhash.WIDE).collect()}
        assert got == {(i, j) for i, j in itertools.combinations(range(n), 2) if shingle_jaccard(own[i], own[j]) >= 0.8} and got
    assert most[0] == 435 and most[1] < 150


def test_between_classes_lists_a_pair_in_one_group_only():
    """Forty members, most pairs in many keys: over all groups of keys and blocks each pair between classes comes once (pipeline)."""
    rng, n, scheme = random.Random(9), 40, simhash.WIDE
    rows = [[i, *(rng.choice([0, 1, 1 << 5, 3 << 30, 1 << 63]) - (1 << 63) for _ in range(4)), *([0] * 8), i % 7, i % 3] for i in range(n)]
    all_rows = pd.DataFrame(rows, columns=["fp", *scheme.columns, "label", "own"])
    segments = np.ascontiguousarray(all_rows[scheme.columns[:4]].to_numpy("<i8")).view("<u4").astype(np.int64)
    found, shared = [], set()
    for number in range(64):
        masked = segments[:, number // 8] & ~(15 << 4 * (number % 8))
        for value in set(masked.tolist()):
            of = all_rows[masked == value].assign(key=(number << 32) | value)
            shared |= {(x, y) for x, y in itertools.combinations(of["fp"], 2) if x % 7 != y % 7}
            for i in range(3):
                for j in range(i, 3):
                    g = of[of["own"].isin([i, j])].assign(i=i, j=j)
                    if len(g):
                        found += [(min(x, y), max(x, y)) for x, y, _ in simhash.between_classes(g, scheme, 10_000)[0]]
    assert len(shared) > 300 and set(found) == shared
    assert max(Counter(found).values()) <= 2  # a class lists its pairs, so a pair has two lists at most


def test_keep_one_judges_rows_not_ids(spark):
    a, b = "one text of quite a few words that stays as it is", "another text that has nothing to do with the first"
    df = spark.createDataFrame([(3, a, 1), (8, b, 2), (8, a, 3), (9, b, 4), (9, b, 5)], "doc_id long, text string, th int")
    assert sorted((r[0], r[1]) for r in simhash.keep_one(df).collect()) == [(3, a), (8, b)]
    both = spark.createDataFrame([(5, a), (5, b)], "doc_id long, text string")
    assert simhash.keep_one(both).count() == 2 and {r["component_id"] for r in simhash.groups(both).collect()} == {5}
    assert simhash.keep_one(empty(spark)).count() == 0


def test_components_of_large_ids_and_too_few_rounds(spark):
    big = (1 << 62) + 5
    edges = spark.range(3000).select((F.col("id") * 7 + big).alias("x"), (F.col("id") * 7 + big + 1).alias("y"))
    assert graph.components(edges).agg(F.count_distinct("component"), F.count("*")).first() == (3000, 6000)
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(60)], "x long, y long"), rounds=1)


def test_components(spark):
    got = graph.components(spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (5, 5)], "x long, y long")).collect()
    assert {r["node"]: r["component"] for r in got} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- 8

@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdefghié ÉΣİ1²'sst!?<|>\n\t世界ß‐ﬁ"), max_size=40), max_size=8))
def test_bpe_is_the_public_encoding(public, texts):
    texts = [*texts, "a<|endoftext|>b <|startoftext|>", "don't we'll THE the"]
    v = bpe.vocabulary(queries.vocabulary_path())
    for mine, ref in zip(v.encode(texts), public.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.tolist() == ref.ids and v.decode(mine) == public.decode(ref.ids, skip_special_tokens=False)


def test_bpe_columns(spark, public):
    path = queries.vocabulary_path()
    for coded in (bpe.decode(bpe.encode(odd_docs(spark), path, into="tok"), path, "tok", "back").select("text", "tok", "back"), bpe.encode_decode(odd_docs(spark), path).select("text", F.col("coded.ids").alias("tok"), F.col("coded.decoded").alias("back"))):
        for r in coded.collect():
            ids = public.encode(r["text"] or "", add_special_tokens=False).ids
            assert r["tok"] == ids and r["back"] == public.decode(ids, skip_special_tokens=False)


# --- 9

def brute_best(scores):
    return max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0)


@given(st.lists(st.integers(-4, 4), max_size=24))
def test_segments_hold_the_best_one_and_are_disjoint(scores):
    got = toxicity.segments([float(s) for s in scores])
    assert max((s for _, _, s in got), default=0) == max(0, brute_best(scores))
    assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))
    assert all(s == sum(scores[a:b]) > 0 for a, b, s in got)


def test_toxicity_learns_words_and_prefixes(spark):
    rng = random.Random(3)
    plain = ["alpha", "beta", "gamma", "delta", "house", "river", "stone"]
    texts, y = [], []
    for i in range(240):
        w = [rng.choice(plain) + rng.choice(["", "s", "ed"]) for _ in range(60)]
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(["idiot", "moron", f"lowei{rng.choice('abcdefghk')}{rng.choice('xyz')}"])
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    m = toxicity.Model(texts, y)
    assert m.predict("alpha beta idiot gamma")[0] > 0.7 > 0.3 > m.predict("alpha beta gamma stone river")[0]
    assert m.predict("alpha beta loweizzz gamma")[0] > 0.7 and m.predict("alpha moron beta")[1]
    got = toxicity.predict(odd_docs(spark), m).select("__toxic.score").collect()
    assert len(got) == 12 and all(0 <= r[0] <= 1 for r in got)
    assert toxicity.Model(["a"], [0]).predict("a") == (0.0, [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not toxicity.fit(odd_docs(spark), none).ready


# --- 10

def brute_judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S).group()
        path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(t), v == "block", t, v) for v, t in rules for h, p in [(t.split("/")[0], "/" + t.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


@pytest.mark.parametrize("small", [50_000, 0])
def test_url_filter(spark, small):
    rng = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "xcom", "org", "w.org", "", "A.Com", "a.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/77?x", "/de/#e", "//x", "/en/7\n1"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)] + [None, "", "nope", "a://b://c", "http://a.com/en/7"] * 2
    rules = [("block", "com/en/"), ("allow", "a.com/en/7"), ("block", "b.a.com/"), ("allow", "org/"), ("block", "w.org/en"), ("block", "com/en/"), ("allow", "com/e")]
    df = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = urlfilter.judge(df, urlfilter.rules_table(spark, rules), small=small, ranges=3, salts=2).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [brute_judge(u, set(rules)) for u in urls]
    assert urlfilter.judge(df.limit(0), urlfilter.rules_table(spark, rules), small=small).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(df, urlfilter.rules_table(spark, rules).limit(0)).collect()} == {"allow"}


def test_url_filter_keeps_odd_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/en/", "x", "y"), (1, "http://a.com/en/", "x", "y")], "page_id long, url string, __h string, __found string")
    for small in (50_000, 0):
        got = urlfilter.judge(df, urlfilter.rules_table(spark, [("block", "com/en/")]), small=small)
        assert got.columns == ["page_id", "url", "__h", "__found", "host", "path", "rule", "verdict"] and [tuple(r) for r in got.collect()] == [(1, "http://a.com/en/", "x", "y", "a.com", "/en/", "com/en/", "block")] * 2


def test_odd_columns_and_empty_tables_of_scorers(spark):
    """Clashing columns stay where operators add results of their own, and empty tables give no rows."""
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (quality.score(docs, quality.fit(docs, none)), toxicity.predict(docs, toxicity.fit(docs, none)), langid.predict(docs, langid.fit(docs))):
        assert [c for c in scored.columns if c in docs.columns] == docs.columns and scored.count() == 12
        assert sorted(str(r["score"]) for r in scored.select("score").collect()) == ["0.5"] * 12
    assert quality.score(empty(spark), quality.fit(docs, none)).count() == 0 and toxicity.predict(empty(spark), toxicity.fit(docs, none)).count() == 0
    assert bpe.encode(empty(spark), queries.vocabulary_path()).count() == 0 and decontam.clean(empty(spark), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_url_sql(spark):
    from compare import differs, duck

    assert differs(queries.op10_url_filters(spark, SF).toPandas(), duck(SF).execute(queries.oracle_sql()["op10_url_filters"]).df()) == ""


# --- pipeline

def test_pipeline_stages_agree_with_their_operators(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    assert p.run(spark, SF).select("doc_id").toPandas()["doc_id"].sort_values().tolist() == sorted(r["doc_id"] for r in kept.collect())
    words = [r["text"] for r in kept.collect() if len(r["text"]) < 4000]
    assert max(shingle_jaccard(x, y) for i, x in enumerate(words) for y in words[:i]) < 0.9


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline as p

    for docs in (odd_docs(spark), empty(spark)):
        for name, stage in p.STAGES:
            got = stage(spark, docs, SF)
            assert name == "bpe" or got.columns == docs.columns
            assert got.count() <= docs.count()
