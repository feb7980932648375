"""The audit against plain integers and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from textloom.llm import divergence, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=3, best=200):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = TERM.findall(low(text or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g for g, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for g, s in counts if g == lang]
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(own[s]) for s in sources}, share(whole)
        for s in sources:
            parts = {"pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s], "term": [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: None if part == "pair" else best]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def check(spark, rows, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, divergence.audit(df, **settings).collect()))
    assert got == brute(rows, **{k: v for k, v in settings.items() if k in ("min_docs", "best")})
    return got


def corpus(seed, n=400, sources=11):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("wort", "Élan", "naïve", "Term", "ß", "日本", "x") for b in "abcdefgh"] + ["THE"] * 40
    return [(i, " ".join(rng.choice(words) + rng.choice((" ", "1", "-", ".\n")) for _ in range(rng.randint(0, 40))), rng.choice(("en", "en", "de")), "src0" if rng.random() < 0.4 else f"src{rng.randrange(sources)}") for i in range(n)]


def test_blocks_slices_and_rounds(spark):
    rows = corpus(1)
    whole = check(spark, rows)
    assert {r[2] for r in whole} == {"pair", "term"}
    for block_sources, slice_terms in ((1, 7), (2, 1000), (3, 5), (4, 16)):
        assert check(spark, rows, block_sources=block_sources, slice_terms=slice_terms) == whole


def test_more_rounds_than_a_wave(spark, monkeypatch):
    monkeypatch.setattr(divergence, "WAVE", 2)
    check(spark, corpus(2, sources=30), block_sources=1, best=3)


def test_nulls_empties_and_repeats(spark):
    rows = [(1, None, None, None), (2, "", "", ""), (3, "alpha Beta", None, "a"), (3, "alpha Beta", None, "a"), (4, "ALPHA gamma", "", None), (5, "42 -- ++", "en", "a"), (6, "only two", "en", "b"), (7, "only two", "en", None), (None, "alpha", "", "c\n\t'é"), (8, None, "fr", "alone")]
    got = check(spark, rows)
    assert [r for r in got if r[0] == "en" and r[2] == "pair" and r[4] == 0] and not [r for r in got if r[0] == "fr"]


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ties_go_by_bytes(spark):
    rows = [(i, "zeta ～a \U0001d4d0b eta", "en", s) for i in range(3) for s in ("a", "b", "～", "\U0001d4d0")] + [(9, "other words", "en", "c")]
    check(spark, rows)


def test_other_columns(spark):
    df = spark.createDataFrame([(1, "one two", "en", "a", 5, "x", "y")] * 3, "rank int, body string, l string, s string, value int, item string, part string")
    assert [r.item for r in divergence.audit(df, "l", "s", "body").collect()] == []
    more = df.union(spark.createDataFrame([(1, "one", "en", "b", 5, "x", "y")], df.schema))
    found = divergence.audit(more, "l", "s", "body").filter("part = 'term'").orderBy("source", "rank").collect()
    assert [(r.source, r.item, r.rank) for r in found] == [("a", "two", 1), ("b", "one", 1)]


def test_long_text_in_pieces():
    text = "Ab1é" * 50_000 + "x" * 100_000 + " end"
    for piece in (1, 7, 1000, 1 << 22):
        assert [t for part in divergence.terms_of(text.encode(), piece) for t in part] == [t.encode() for t in TERM.findall(text.lower())]


def test_flushes(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(divergence, "FLUSH", 20)
    assert divergence._count.__globals__["FLUSH"] == 20
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (2, 3, 1)], ["lang", "source", "text"])
    total = Counter()
    batches = list(divergence._count(iter([batch])))
    for b in batches:
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((r[2], r[3], t) for r in rows for t in TERM.findall("".join(c.lower() if c.isascii() else c for c in r[1])))
    assert total == want and len(batches) > 50


def test_shares_do_not_overflow():
    counts = np.array([[0, 10**15, 4 * 10**15]])
    p = divergence.shares(counts, np.array([5 * 10**15]), 3)
    assert p.tolist() == [[1 + 10**9 * (int(c) + 1) // (5 * 10**15 + 3) for c in counts[0]]]
    assert divergence.shares(np.array([[7]]), np.array([7]), 1).tolist() == [[10**9 + 1]]


@pytest.mark.parametrize("blocks", range(2, 12))
def test_tournament_meets_once(spark, blocks):
    turns = divergence.rounds_of(blocks)
    df = spark.range(blocks).selectExpr("id as block", f"{blocks}L as blocks", f"explode(sequence(0L, {turns}L - 1)) as turn")
    met = df.withColumn("host", divergence.opponent(df.block, df.turn, df.blocks)).filter(f"host < {blocks}").collect()
    for r in met:
        assert r.block != r.host and any(o.block == r.host and o.host == r.block and o.turn == r.turn for o in met)
    assert Counter((r.block, r.host) for r in met) == Counter((a, b) for a in range(blocks) for b in range(blocks) if a != b)


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(f"select lang, source, part, item, value, rank from ({queries.oracle_sql()['op13_divergence']})").fetchall()
    got = queries.op13_divergence(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
