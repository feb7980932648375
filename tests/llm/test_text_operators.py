"""Decontamination, extraction, language, quality and BPE: brute force, round trips, held-out rows, and odd inputs."""

import hashlib
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, html_extract, langid, quality, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "a"), (4, "  \t\n "), (5, "Same text here."), (5, "Same text here."), (None, "No id."), (6, LONG), (7, " 　é\U0001f600‍"), (8, "x\0y �"), (9, "!!! ???")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_decontamination_by_brute_force(spark):
    docs, items = rows_of("documents"), rows_of("benchmark")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op1_decontaminate(spark, SF).collect()}
    assert got == decontaminate.brute_force([(d["doc_id"], d["text"]) for d in docs], [(i["item_id"], i["text"]) for i in items])


def test_decontamination_by_hashes_and_a_join(spark):
    """A benchmark that counts as large: hashes in many slices, and in one."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = decontaminate.brute_force([(d["doc_id"], d["text"]) for d in rows_of("documents")], [(i["item_id"], i["text"]) for i in rows_of("benchmark")])
    for hash_bytes in (1 << 12, 1 << 26):
        found = decontaminate.find_leaks(docs, bench, slice_bytes=1, hash_bytes=hash_bytes)
        assert {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(found).collect()} == want
    clash = docs.select("doc_id", "text", F.lit(1).alias("x"), F.lit("s").alias("size"), F.lit(2).alias("h"), F.lit(3).alias("words"))
    small, large = (sorted(map(tuple, decontaminate.decontaminate(clash, bench, mode="cut", slice_bytes=b).collect())) for b in (1 << 22, 1))
    assert small == large and len(small) == len(want)


def test_window_hashes_stay_within_texts():
    texts = [b"a b c", b"", b"  ", b"B c", b"x", b"a b"]
    owner, place, h = decontaminate.hashed_windows(texts, 2)
    assert list(zip(owner.tolist(), place.tolist())) == [(0, 0), (0, 1), (3, 0), (5, 0)] and h[1] == h[2] and h[0] == h[3] != h[1]
    assert [len(x) for x in decontaminate.hashed_windows([], 3)] == [0, 0, 0] and [len(x) for x in decontaminate.hashed_windows([b""], 3)] == [0, 0, 0]


def test_decontamination_of_odd_rows(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    docs = [*ODD, (20, "X one TWO three, four; five six-seven eight nine ten y"), (21, "b a b"), (22, " ".join(words) + " " + " ".join(words)), (23, "one two three four five six seven eight nine")]
    items = [(1, " ".join(words)), (2, "a b"), (2, "a b"), (10, None), (11, "..."), (None, "seven eight nine"), (12, "a b")]
    named = [(i, f"q{k}", t) for k, (i, t) in enumerate(items)]
    bench = spark.createDataFrame(named, "item_id long, doc_id string, text string")
    extra = frame(spark, docs).withColumn("n_hit", F.lit("clash"))
    found = decontaminate.find_leaks(extra, bench)
    got = {(r.doc_id, r.n_hit): r for r in decontaminate.digest(found).collect()}
    expected = decontaminate.brute_force([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None])
    plain = {r.doc_id: r for r in decontaminate.digest(found).collect()}
    for k, v in expected.items():
        if k not in (20, 22, 23):
            assert tuple(plain[k])[1:] == v
    assert plain[20].n_items == 1 and plain[21].n_items == 2 and plain[23].n_items == 0 and plain[23].n_hit == 3 and len(got) >= len(plain) - 1
    sliced = decontaminate.digest(decontaminate.find_leaks(frame(spark, docs), bench, slice_bytes=40))
    assert sorted(map(tuple, sliced.collect()), key=repr) == sorted(map(tuple, decontaminate.digest(found).collect()), key=repr)
    kept = decontaminate.decontaminate(extra, bench)
    assert kept.columns == extra.columns and {r.doc_id for r in kept.collect()}.isdisjoint({20, 21, 22, 23})
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(extra, bench, mode="cut").collect()}
    assert cut[20] == "X  y" and cut[21] == "b " and cut[1] is None and cut[6] == LONG
    assert decontaminate.find_leaks(extra, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find_leaks(extra.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(extra, bench, mode="other")


def test_extraction_of_the_tables_pages(spark):
    import re

    got = {r.page_id: r for r in queries.op2_main_text(spark, SF).collect()}
    for p in rows_of("pages"):
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        lines = (" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", article))
        assert got[p["page_id"]].text == "\n".join(filter(None, lines)) and got[p["page_id"]].n_chars == len(got[p["page_id"]].text)


PARAGRAPH = "<p>A paragraph of some length, number {}, with enough words in it to look like the text of an article &amp; more.</p>"
BODY = "".join(PARAGRAPH.format(i) for i in range(5))
PLAIN = "\n".join(unescape(PARAGRAPH.format(i))[3:-4] for i in range(5))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("just &lt;text&gt;", "just <text>"), ("<p>one", "one"),
        (f"<body><div class='menu'><a href=a>A</a> <a href=b>B</a></div><div>{BODY}</div><div id=sidebar><p>Other things to read in some other place.</p></div></body>", PLAIN),
        (f"<body><header><h1>Site</h1></header><article>{BODY}<div class='comments'><p>I like this a lot, thank you for it.</p></div></article><footer>f</footer></body>", PLAIN),
        (f"<main><h1>T\n  t</h1>{BODY}<form>Sign up <button>Go</button></form><script>if (a < b) x('</p>')</script><aside>x</aside></main>", "T t\n" + PLAIN),
        (f"<body><div class=cookie-notice>We use cookies.</div><div>{BODY}<ul><li>one<li>two</ul></div><!-- <p>gone</p> --></body>", PLAIN + "\none\ntwo"),
        (f"<body><div style='display:none'>{BODY}</div><section>{BODY}</section></body>", PLAIN),
        ("<article><p>a&nbsp;&nbsp;b\t c<br>d<p><b>e<p>f</b>g</article>", "a b c\nd\ne\nfg"),
        (f"<body><div class='page with-sidebar'><div class=sidebar>s</div><article>{BODY}</article></div></body>", PLAIN),
        (f"<body><div><div>{BODY}</div></div><section id=comments><article class=comment-body><p>I like this a lot, thank you for it.</p></article></section></body>", PLAIN),
        ("<article><p>1 < 2 and a <b>bold</b>move &#x41;&copy;</p></article>", "1 < 2 and a boldmove A©"),
    ],
)
def test_extraction_of_odd_pages(html, text):
    assert html_extract.extract_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<article>{BODY}<p class='notice-period'>n</p><div class='social-history'><p>s</p></div><p class=life-form>l</p></article>", PLAIN + "\nn\ns\nl"),
        (f"<body><article><p>Take <math><mi>x</mi></math> and <label>a label</label>.</p>{BODY}</article></body>", "Take x and a label.\n" + PLAIN),
        (f"<body><main><article>{BODY}</article><article>{BODY}</article></main><div class=ad>Buy this now.</div></body>", PLAIN + "\n" + PLAIN),
        (f"<body><main><h1>Title</h1><article>{BODY}</article></main></body>", "Title\n" + PLAIN),
        (f"<body><ul><li><a href=a>A</a><li><a href=b>B</a></ul><div><div>{BODY}</div></div><div>Buy this, it is cheap.</div></body>", PLAIN),
        (f"<body><form><nav><a href=a>A</a></nav><div>{BODY}</div><input name=q></form></body>", PLAIN),
        (f"<body><header><div><article>{BODY}</article></div></body>", PLAIN),
        (f"<article>{BODY}<ul><li><a href=a>One link</a><li><a href=b>Another</a></ul><article><p>I like this.</p></article></article>", PLAIN + "\nOne link\nAnother"),
        (f"<body><div>{BODY}<ul><li><a href=a>One link</a><li><a href=b>Another</a></ul></div></body>", PLAIN),
        (f"<body><article><h1>T</h1><article>{BODY}</article></article></body>", "T\n" + PLAIN),
        (f"<body><article><article>{BODY}</article><article>{BODY}</article></article></body>", PLAIN + "\n" + PLAIN),
        (f"<article>{BODY}" + "<article><p>I like this, and I have much to say about all of it.</p><article><p>So do I.</p></article></article>" * 9 + "</article>", PLAIN),
        (f"<article>{BODY}<p class=share>a</p><p class='lead ad'>b</p><p id=related>c</p><div class='ad free'><p>d</p></div><div class=ad>e</div></article>", PLAIN + "\na\nb\nc\nd"),
        (f"<article><div><p>First.</p></div><div>{BODY}</div><div><p>Last.</p></div></article>", "First.\n" + PLAIN + "\nLast."),
        (f"<body><article><h3>Above</h3><div>{BODY}</div><h4>Below</h4><p>x</p></article></body>", "Above\n" + PLAIN + "\nBelow\nx"),
        (f"<body><div><h3>Above</h3><div>{BODY}</div><h4>More to read</h4></div></body>", "Above\n" + PLAIN),
        (f"<article>{BODY}<fieldset><legend>L</legend>text</fieldset><p role=status>s</p><div role=alert>w</div></article><p role=status>Notice.</p>", PLAIN + "\nL\ntext\ns\nw"),
        (f"<article>{BODY}<section id=comments>{BODY}{BODY}{BODY}</section></article>", PLAIN + ("\n" + PLAIN) * 3),
        (f"<body><p>{'word ' * 40}</p><p>{'more ' * 40}</p></body>", ("word " * 40).strip() + "\n" + ("more " * 40).strip()),
    ],
)
def test_extraction_goes_by_density(html, text):
    assert html_extract.extract_text(html) == text


def test_names_decide_nothing_on_the_tables_pages(monkeypatch):
    pages = [p["html"] for p in rows_of("pages")]
    found = [html_extract.extract_text(h) for h in pages]
    monkeypatch.setattr(html_extract, "NAMES", frozenset())
    assert [html_extract.extract_text(h) for h in pages] == found


@pytest.mark.parametrize("seed", range(20))
def test_densities_by_their_definition(seed):
    """Characters, tags and links counted anew for every node, and the formula as it is published."""
    import math
    import random

    rng = random.Random(seed)
    made = lambda depth: "".join(rng.choice(["some words ", f"<p>{'w ' * rng.randrange(9)}</p>", f"<a href=x>{'l' * rng.randrange(1, 9)}</a>", f"<div>{made(depth - 1) if depth else ''}</div>", "<br>", "<b>bold</b>"]) for _ in range(rng.randrange(1, 7)))
    root = html_extract.parse(f"<body>{made(3)}</body>")
    html_extract.clear(root)

    def figures(node, link=False):
        c = t = lc = lt = 0
        for p in node.parts:
            if isinstance(p, str):
                c, lc = c + len("".join(p.split())), lc + link * len("".join(p.split()))
            else:
                inner = figures(p, link or p.tag == "a")
                c, t, lc, lt = c + inner[0], t + 1 + inner[1], lc + inner[2], lt + inner[3] + (p.tag == "a" or link)
        return c, t, lc, lt

    body = figures(root)
    for node in html_extract.measure(root):
        c, t, lc, lt = figures(node, node.tag == "a")
        assert (node.c, node.t, node.lc) == (c, t, lc)
        lt = node.lt
        if c:
            base = math.log(c / max(c - lc, 1) * lc + body[2] / max(body[0], 1) * c + math.e)
            assert node.density == pytest.approx(c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)), 1e-7) / base, abs=1e-4)
        assert node.total == pytest.approx(sum(p.density for p in node.children() if p.tag not in html_extract.FORMATTING))


@pytest.mark.parametrize("seed", range(30))
def test_selection_by_its_definition(seed):
    """The node of the largest density sum, with densities counted anew, is what the text comes from."""
    import math
    import random

    rng = random.Random(seed)
    words = iter(range(10**6))
    text = lambda n: " ".join(f"w{next(words)}" for _ in range(n))

    def made(depth):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4 if depth else 2)
            parts.append(("p", [text(rng.randrange(1, 40))]) if kind == 0 else ("a", [text(rng.randrange(1, 4))]) if kind == 1 else ("div" if kind == 2 else "section", made(depth - 1)))
        return parts

    page = ("body", made(3))
    html = lambda node: node if isinstance(node, str) else f"<{node[0]}>" + "".join(map(html, node[1])) + f"</{node[0]}>"

    def figures(node):
        """Characters, tags, link characters, link tags."""
        if isinstance(node, str):
            return len(node.replace(" ", "")), 0, 0, 0
        inner = [figures(p) for p in node[1]]
        c, t, lc, lt = (sum(x) for x in zip(*inner))
        t, lt = t + sum(not isinstance(p, str) for p in node[1]), lt + sum(p[0] == "a" for p in node[1] if not isinstance(p, str))
        return (c, t, c, t) if node[0] == "a" else (c, t, lc, lt)

    whole = figures(page)

    def density(node):
        c, t, lc, lt = figures(node)
        t = max(t, 1)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0000001)) / math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e)

    below = lambda node: [x for p in node[1] if not isinstance(p, str) for x in (p, *below(p))]
    total = lambda node: sum(density(p) for p in node[1] if not isinstance(p, str) and p[0] != "a")
    core = max(below(page), key=total)
    tree = html_extract.parse(html(page))
    html_extract.clear(tree)
    path, threshold = html_extract.choose(tree, html_extract.measure(tree))
    if total(core) > 0:
        assert path[0].total == pytest.approx(total(core)) and path[0].c == figures(core)[0]
        on_path = [page, *(x for x in below(page) if core is x or any(core is y for y in below(x)))]
        assert threshold == pytest.approx(min(density(x) for x in on_path))
        got = html_extract.extract_text(html(page)).split()
        for p in below(core):
            if p[0] == "p":
                assert p[1][0].split()[0] in got


def test_extraction_of_deep_and_long_pages_takes_linear_time():
    import time

    def took(html):
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            html_extract.extract_text(html)
            best = min(best, time.perf_counter() - began)
        return best

    for page in (lambda n: "<div>" * n + "</p>x</i>" * n, lambda n: "<span>" * n + "<p>x</p>" * n, lambda n: "<form>" * n + "x" + "<ul><li>y" * n, lambda n: "<header><b>" * n + "z", lambda n: "<article>x y" * n):
        assert took(page(8000)) < 40 * took(page(800)) + 0.2


def test_extraction_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x", "t"), (2, "v", "<p>" + LONG + "</p>", "t")], "page_id long, url string, html string, text string")
    got = html_extract.digest(pages).collect()
    assert [r.text for r in got] == ["", "", "x", LONG] and html_extract.digest(pages.limit(0)).count() == 0
    assert html_extract.extract_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op3_language(spark, SF).collect()}
    docs = rows_of("documents")
    held = [d for d in docs if got[d["doc_id"]].held_out]
    assert len(got) == len(docs) and held and np.mean([got[d["doc_id"]].lang_pred == d["lang"] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    learn = frame(spark, [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(learn)
    got = {(r.doc_id, i): (r.lang_pred, r.score) for i, r in enumerate(langid.predict(frame(spark, ODD), model).collect())}
    assert len(got) == len(ODD)
    by = {k[0]: v for k, v in got.items()}
    assert by[1] == by[2] == by[4] == by[9] == ("und", 0.0) and by[3][0] in ("en", "de") and 0 < by[3][1] <= 1
    texts = ["the dog", "die Katze und", "", None, "a\0b"]
    assert [x for t in texts for x in model.predict([t])[0]] == model.predict(texts)[0]
    assert np.allclose([x for t in texts for x in model.predict([t])[1]], model.predict(texts)[1])
    assert {r.lang_pred for r in langid.predict(frame(spark, ODD), langid.fit(learn.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.fit(learn, most_langs=1)


def test_language_by_brute_force(spark):
    """Grams of runs of letters counted one by one; priors are shares of training rows; letters of all planes count."""
    learn = [("en", "The cat, and 2 dogs!"), ("en", "a dog"), ("en", None), ("de", "Der Hund und die Katze"), ("x", "\U00031350\U00031351 \U00031350"), (None, "nothing")]
    df = frame(spark, [(i, t, k) for i, (k, t) in enumerate(learn)], "doc_id long, text string, lang string")
    model = langid.fit(df, bits=16)

    def grams_of(text):
        marked = "\0" * 3 + "".join(c if c.isalpha() else " " for c in text.lower()) + "\0" * 3
        import re

        body = re.sub(" +", " ", marked.strip("\0"))
        return [langid.grams([g], 16) for g in [body]][0][0]

    counts = {k: np.full(1 << 16, 0.5) for k in ("de", "en", "x")}
    rows = {k: sum(1 for a, t in learn if a == k and t is not None) for k in counts}
    for k, t in learn:
        if k and t is not None:
            for row in grams_of(t):
                np.add.at(counts[k], row, 1)
    for text in ("the dog", "Katze", "\U00031350", "und and", "q"):
        logs = {k: np.log(rows[k] / sum(rows.values())) + sum(np.log(c / c.sum())[row].sum() for row in grams_of(text)) for k, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        lang, score = model.predict([text])
        assert lang == [best] and score[0] == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), rel=1e-4)


def test_grams_one_at_a_time():
    """Every gram of every text spelled out, and hashed in whole numbers; texts beside it make no difference."""
    bits = 16

    def plain(text):
        symbols, gap = [], False
        for ch in (text or "").replace("\0", " ").lower():
            if ch.isalpha():
                symbols.append(ord(ch))
                gap = False
            elif not gap:
                symbols.append(1)
                gap = True
        symbols += [0, 0, 0]
        out = []
        for i in range(len(symbols) - 2):
            h, row = 0, []
            for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
                h = (symbols[i] if k == 0 else h ^ symbols[i + k]) * m % 2**64
                row.append(h >> (64 - bits))
            out.append(row)
        return out

    texts = [t for _, t in ODD] + ["", None, "a", "Ünï!! çode\0 x", "", "123", "abc def", None]
    for some in (texts, texts[::-1], texts[3:4], [""], [None, None]):
        buckets, starts, has = langid.grams(some, bits)
        edges = [*starts.tolist(), buckets.shape[1]]
        for k, t in enumerate(some):
            assert buckets[:, edges[k] : edges[k + 1]].T.tolist() == plain(t)
            assert has[k] == any(ch.isalpha() for ch in (t or "").lower())


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, "/root/testdata/sf0.01").collect()}
    held = [x for x in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist() if got[x["doc_id"]].held_out]
    good, bad = ([got[x["doc_id"]].score for x in held if x["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.95
    assert np.mean([got[x["doc_id"]].predicted == x["quality"] for x in held]) >= 0.9
    assert all(r.predicted == (r.score >= 0.7) for r in got.values())


def test_quality_of_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(2, 0), (3, 1), (5, 1), (5, 0), (6, 1), (9, 0), (None, 1), (1, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    for some in (labels.limit(0), labels.filter("quality = 1")):
        flat = quality.fit(docs, some)
        assert {round(r.score, 9) for r in quality.score(docs, flat).collect()} == {0.7}
    extra = docs.withColumn("score", F.lit("clash"))
    kept = quality.filter_quality(extra, model)
    assert kept.columns == extra.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    whole = quality.features([(t or "").encode() for _, t in ODD])
    assert np.allclose(whole, np.vstack([quality.features([(t or "").encode()]) for _, t in ODD]))


@pytest.mark.parametrize("seed", range(3))
def test_quality_weights_are_the_likeliest(seed):
    """The penalised likelihood of the drawn preferences, written out, climbed by plain gradient steps from elsewhere."""
    import math

    rng = np.random.default_rng(seed)
    x = rng.standard_normal((60, 5))
    good = x[:, 0] - 0.5 * x[:, 1] + 0.8 * rng.standard_normal(60) > 0
    model = quality.fit_pairs(x, good, 0.7, pairs=300, seed=seed, ridge=0.05, steps=50)
    up, down = quality.draw(good, 300, seed)
    assert good[up].all() and not good[down].any()
    shaped = [[c for c in row] for row in model.shaped(x)]

    def likelihood(w):
        strength = [sum(a * b for a, b in zip(row, w)) for row in shaped]
        return sum(-math.log1p(math.exp(strength[j] - strength[i])) for i, j in zip(up, down)) / 300 - 0.025 * sum(a * a for a in w)

    best = likelihood(model.weights)
    for _ in range(40):
        assert likelihood(model.weights + rng.standard_normal(len(model.weights)) * rng.choice([1e-3, 1e-2, 0.3])) < best
    w = rng.standard_normal(len(model.weights))
    z = np.array(shaped)
    for _ in range(4000):
        gap = (z[up] - z[down]) @ w
        w += 0.3 * ((z[up] - z[down]).T @ (1 / (1 + np.exp(gap))) / 300 - 0.05 * w)
    assert np.allclose(w, model.weights, atol=1e-3)
    # the threshold parts the labels best of all levels between two rows
    strength = z @ model.weights
    parted = lambda level: np.mean(strength[good] >= level) - np.mean(strength[~good] >= level)
    assert parted(model.threshold) >= max(parted(s) for s in strength) - 0.05
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + math.exp(-((strength[0] - model.threshold) / model.spread + math.log(0.7 / 0.3)))))


def test_quality_learns_from_every_labelled_row(spark, tmp_path):
    """The weights climb the likelihood of all pairs of each block; with one block, of all pairs there are."""
    rng = np.random.default_rng(2)
    good = rng.random(90) < 0.4
    docs = [(i, " ".join(rng.choice(["a", "bb.", "CCC", "d1", "!!"], 12, p=[0.4, 0.3, 0.1, 0.1, 0.1] if g else [0.2, 0.2, 0.2, 0.2, 0.2]))) for i, g in enumerate(good)]
    df, labels = frame(spark, docs), spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    model = quality.fit(df, labels, ridge=0.05)
    x = quality.features([t.encode() for _, t in docs])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-6))
    z = model.shaped(x)
    diff = (z[good][:, None, :] - z[~good][None, :, :]).reshape(-1, z.shape[1])
    miss = 1 / (1 + np.exp(diff @ model.weights))
    assert np.abs((diff * miss[:, None]).mean(axis=0) - 0.05 * model.weights).max() < 1e-6
    strength = z @ model.weights
    parted = lambda level: np.mean(strength[good] >= level) - np.mean(strength[~good] >= level)
    assert parted(model.threshold) >= max(map(parted, strength)) - 1e-3 and model.spread == pytest.approx(strength.std() / 2)
    assert np.allclose(quality.fit(df, labels, ridge=0.05, most=0).weights, model.weights)
    # in many blocks, and with one good row in all of them, every row still counts
    many = quality.fit(df, labels, ridge=0.05, rows=8)
    assert np.corrcoef(z @ many.weights, strength)[0, 1] > 0.9 and np.allclose(many.mean, model.mean)
    rare = quality.fit(df, labels.filter("quality = 0 or doc_id = " + str(int(np.flatnonzero(good)[0]))), ridge=0.05, rows=8)
    assert rare.weights.any() and rare.score(x[good][:1])[0] >= 0.7


def test_quality_features_by_their_names():
    import zlib

    for t in ODD:
        raw = (t[1] or "").encode()
        got = dict(zip(quality.FEATURES, quality.features([raw])[0]))
        words, lines, n = raw.split(), raw.split(b"\n"), max(len(raw.split()), 1)
        size = max(len(raw), 1)
        assert got["log bytes"] == pytest.approx(np.log1p(len(raw))) and got["log words"] == pytest.approx(np.log1p(len(words)))
        assert got["capitals"] == pytest.approx(sum(65 <= b <= 90 for b in raw) / size) and got["digits"] == pytest.approx(sum(48 <= b <= 57 for b in raw) / size)
        assert got["beyond ASCII"] == pytest.approx(sum(b > 127 for b in raw) / size) and got["exclamation marks"] == pytest.approx(raw.count(b"!") / size)
        assert got["distinct words"] == pytest.approx(len(set(words)) / n**0.8) and got["distinct lines"] == pytest.approx(len(set(lines)) / len(lines))
        assert got["most frequent word"] == pytest.approx(max(map(words.count, set(words)), default=0) / n) and got["word length"] == pytest.approx(len(raw) / n)
        shares = quality.features([raw])[0, len(quality.FEATURES) :]
        want = [sum(zlib.crc32(w.lower()) % quality.WORDS == b for w in words) for b in range(quality.WORDS)]
        assert np.allclose(shares**2 * n, want)


def test_quality_counts_every_word():
    line = " ".join(f"w{i}" for i in range(25))
    flooded = " ".join("flood" if i % 25 else f"w{i}" for i in range(5000))  # every 25th word is another
    got = quality.features([" ".join([line] * 200).encode(), flooded.encode(), b""])[:, quality.FEATURES.index("most frequent word")]
    assert np.allclose(got, [0.04, 0.96, 0])


def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_file())
    odd = [*ODD, (30, "<|endoftext|>a<|startoftext|> it's I'LL 3d ÀÉ é"), (31, "İSTANBUL ß ǅ ﬁ x\x0by\x1cz")]
    docs = [(d["doc_id"], d["text"]) for d in rows_of("documents")] + odd
    df = frame(spark, docs).withColumn("block", F.lit("clash"))
    got = sorted(bpe.encode(df, ids=True, decoded=True, block_bytes=1 << 16).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.ids_sha256))
    expected = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in docs), key=lambda r: (r[0] is None, r[0], hashlib.sha256(np.array(r[1], "<u4").tobytes()).hexdigest()))
    assert len(got) == len(expected)
    for r, (i, ids) in zip(got, expected):
        text = tok.decode(ids, skip_special_tokens=False)
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    again = bpe.decode(bpe.encode(frame(spark, odd), ids=True).select("doc_id", "ids"))
    assert {(r.doc_id, r.decoded) for r in again.collect()} == {(i, tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in odd}
    assert bpe.encode(frame(spark, docs).limit(0)).count() == 0


def test_bpe_decode_of_any_ids(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.tokenizer_file())
    lists = [[5, 9, 5], [], None, [5, 9, 5], [1 << 30, 7], [7, None, 8]]
    df = spark.createDataFrame([(i, x, "k", "p", "t", "old") for i, x in enumerate(lists)], "id int, ids array<int>, _key string, key string, text string, decoded string")
    got = bpe.decode(df).orderBy("id").collect()
    piece = lambda i: tok.id_to_token(i)
    assert [r.decoded for r in got] == [" ".join(map(piece, (5, 9, 5))), "", "", " ".join(map(piece, (5, 9, 5))), piece(7), " ".join(map(piece, (7, 8)))]
    assert sorted(got[0].asDict()) == ["_key", "decoded", "id", "ids", "key", "text"] and (got[0]._key, got[0].text) == ("k", "t")


def test_bpe_query_decodes_by_the_join(spark):
    plan = queries.op10_bpe(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in plan and "Join Inner" in plan
    ids, other = bpe.encode(frame(spark, [(1, "some words here")]), ids=True, decoded=True).first(), bpe.encode(frame(spark, [(1, None)]), ids=True, decoded=True).first()
    (joined,) = bpe.decode(spark.createDataFrame([(ids.ids,)], "ids array<int>")).collect()
    assert joined.decoded == ids.decoded and other.decoded == "" and other.n_tokens == 0


def test_bpe_query(spark):
    assert queries.op10_bpe(spark, SF).count() == len(rows_of("documents"))


def test_tokenizers_that_keep_spaces_are_refused():
    import json

    with pytest.raises(ValueError):
        bpe.check_tokenizer(json.load(open(bpe.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8")))
