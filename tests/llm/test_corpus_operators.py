"""WARC, repeats, vectors, scoring, the Jaccard join and components: brute force, SQL, round trips, and odd inputs."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import anchors, common, embed_dedup, induced_sort, lm_scoring, ngram_join, queries, suffix_dedup, warc
from textloom.llm.ngram_join import word_hashes

from .test_text_operators import LONG, ODD, SF, frame, rows_of


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)
    assert mine == sorted(c.execute(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall(), key=repr)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(3, 1), (2, 3), (9, 8), (None, 4)], [(i, i + 1) for i in range(100)], [(0, i) for i in range(1, 60)], [(random.Random(i).randrange(80), random.Random(-i).randrange(80)) for i in range(60)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in common.connected_components(frame(spark, edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == components({x for e in real for x in e}, real)


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    """One task unites what it can hold; edges of many tasks go through rounds, with the same result."""
    made, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: made.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(0, 400)] + [(1000, i) for i in range(1001, 1300)]
    df, want = frame(spark, edges, "a long, b long").repartition(6), components({x for e in edges for x in e}, edges)
    assert {r.node: r.root for r in common.connected_components(df).collect()} == want and len(made) == 2
    assert {r.node: r.root for r in common.connected_components(df, task_edges=50).collect()} == want and len(made) > 4
    words = df.select(F.lpad(F.col("a").cast("string"), 5, "0").alias("a"), F.lpad(F.col("b").cast("string"), 5, "0").alias("b"))
    assert {int(r.node): int(r.root) for r in common.connected_components(words).collect()} == want


# WARC


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    pages = [(1, "http://a", "x"), (2, "http://b\r\nX: y", "x"), (3, None, None), (4, "u", ""), (5, "u", LONG), (6, "é", "WARC/1.1\r\n\r\n\x1f\x8b\x08"), (7, "u", "x"), (7, "u", "x"), (None, "n", "only"), (8, "u", "\U0001f600")]
    df = frame(spark, pages, "page_id long, url string, html string").withColumn("d", F.lit("clash"))
    for size in (1, 97, 1 << 20):
        rows = warc.read_archives(warc.write_archives(df, archive_bytes=300), range_bytes=size if size > 1 else 50).collect()
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in rows) == Counter(
            (i, "revisit" if i in (1, 2, 3) else "response", {1: 7, 2: 7, 3: 4}.get(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in pages
        )
        assert {r.page_id: bytes(r.payload) for r in rows if r.record_type == "response"} == {i: (h or "").encode() for i, _, h in pages if i not in (1, 2, 3)}
    assert next(r.url for r in rows if r.page_id == 2) == "http://b%0D%0AX: y"
    none = warc.write_archives(df.limit(0))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    assert {r.record_type for r in warc.read_archives(warc.write_archives(df.filter("page_id < 3"), revisit_from=2)).collect()} == {"response"}


def test_warc_headers_of_any_length_and_the_count(spark):
    rng = random.Random(5)
    pages = [(i, "http://a/" + "%x" % rng.getrandbits(4 * n), f"page {i}") for i, n in enumerate((10, 70_000, 300_000, 20))]
    df = frame(spark, pages, "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    for size in (5_000, 1 << 20):
        rows = warc.check_count(warc.read_archives(manifest, range_bytes=size), manifest).collect()
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in rows) == pages
    assert warc.digest(df).count() == 4 and warc.digest(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="not the 5"):
        warc.check_count(warc.read_archives(manifest), manifest.limit(1).selectExpr("path", "size", "5L AS records"))


def test_warc_archives_are_gzip_and_damage_is_noticed(spark, tmp_path):
    import gzip

    path = str(tmp_path / "a.warc.gz")
    records = [warc.record(i, f"u{i}", b"payload %d" % i * 50, None, warc.base32_sha1(b"payload %d" % i * 50), "2026-01-01T00:00:00Z") for i in range(20)]
    open(path, "wb").write(b"".join(records))
    assert gzip.open(path).read().count(b"WARC/1.1\r\n") == 20
    size = sum(map(len, records))
    for step in (7, 64, size):
        found = [warc.parse(*r)[2] for s in range(0, size, step) for r in warc.read_range(path, s, min(size, s + step))]
        assert found == list(range(20))
    starts = [sum(map(len, records[:k])) for k in range(20)]
    whole = b"".join(records)
    for k in range(1, 20):  # a member whose first bytes are damaged is missed by whoever reads the one before it
        open(path, "wb").write(whole[: starts[k]] + b"\0" * 12 + whole[starts[k] + 12 :])
        for step in (64, 200, size):
            with pytest.raises(ValueError, match=f"no record at {starts[k]}"):
                for s in range(0, size, step):
                    list(warc.read_range(path, s, min(size, s + step)))
    open(path, "wb").write(whole + b"tail")
    with pytest.raises(ValueError, match="no record"):
        list(warc.read_range(path, 0, size))
    open(path, "wb").write(whole + gzip.compress(b"no record"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.read_range(path, 0, size))
    open(path, "wb").write(b"".join(records)[:-30])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_range(path, 0, size))
    changed = warc.record(1, "u", b"other", None, warc.base32_sha1(b"payload"), "2026-01-01T00:00:00Z")
    open(path, "wb").write(changed)
    with pytest.raises(ValueError, match="digest"):
        [warc.parse(*r) for r in warc.read_range(path, 0, len(changed))]


# repeats


def sort_pieces(pieces, folder, budget):
    symbols = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, 0) for p in pieces]).astype(np.uint16)
    path = str(folder / "symbols")
    symbols.tofile(path)
    parts = list(induced_sort.sort_file(path, 100, budget))[::-1]
    return symbols.tolist(), np.concatenate([p for p, _ in parts]).tolist(), np.concatenate([c for _, c in parts]).tolist()


@pytest.mark.parametrize("seed", range(40))
def test_induced_sorting(tmp_path, seed):
    rng = random.Random(seed)
    kinds = rng.choice([1, 2, 3, 26, 256])
    base = [bytes(rng.randrange(kinds) for _ in range(rng.randrange(rng.choice([12, 300])))) for _ in range(4)]
    pieces = [rng.choice(base)[rng.randrange(3) :] for _ in range(rng.randrange(1, 12))]
    s, order, common_prefix = sort_pieces(pieces, tmp_path, rng.choice([64, 1 << 28]))
    assert sorted(order) == list(range(len(s)))
    end = [s.index(0, i) for i in range(len(s))]
    for a, b, c in zip(order, order[1:], common_prefix[1:]):
        x, y = s[a : end[a]], s[b : end[b]]
        real = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert x[:100] <= y[:100] or y[:100] == x[: len(y)][:100]
        assert min(c, real, 100) == min(real, 100) and (c <= real or real == min(len(x), len(y)) or real >= 100)


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_minimisers(seed):
    rng = random.Random(seed)
    shared = bytes(rng.randrange(97, 101) for _ in range(150))
    texts = [bytes(rng.randrange(97, 101) for _ in range(rng.randrange(0, 90))) + shared + bytes(rng.randrange(97, 101) for _ in range(rng.randrange(0, 300))) for _ in range(5)] + [b"", b"a" * 99, b"a" * 400]
    text, gram, content, first, count = anchors.chunks(texts, 100, batch=rng.choice([1, 300, 1 << 18]))
    flat, windows = b"".join(texts), defaultdict(set)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    seen = []
    for t, g, f, n in zip(text, gram, first, count):
        for p in range(f, f + n):
            windows[flat[p : p + 100]].add(int(g))
            seen.append(p)
            assert begins[t] <= p and p + 100 <= begins[t + 1]
    assert sorted(seen) == [p for a, b in zip(begins, begins[1:]) for p in range(a, b - 99)]
    assert all(len(g) == 1 for g in windows.values())


def repeats(df, **options):
    return Counter(tuple(r) for r in suffix_dedup.find_repeats(df, **options).collect())


@pytest.mark.parametrize("seed", range(4))
def test_repeats_by_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(80, 400))) for _ in range(6)]
    passages += ["z" * 500, "xy" * 150]
    docs = [(i, "".join(rng.choice(passages)[rng.randrange(30) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(200))) for _ in range(rng.randrange(5)))) for i in rng.sample(range(1000), 60)]
    docs += [(2000, None), (2001, ""), (2002, "a" * 99), (2003, LONG), (2004, LONG), (2005, LONG + "x")]
    df = frame(spark, docs).repartition(3).withColumn("block", F.lit("clash"))
    expected = Counter((k, *v) for k, v in suffix_dedup.brute_force(docs).items())
    assert repeats(df, block_bytes=1 << 12, shard_bytes=1 << 13) == expected
    assert repeats(df) == expected
    assert repeats(df, block_bytes=1 << 12, hot=1) == expected
    assert repeats(df, block_bytes=1 << 14, hot=3, shard_bytes=1 << 11) == expected


def test_a_passage_in_very_many_surroundings_is_divided(spark):
    """Chunks of one gram differ on both sides of it, some in few bytes only."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefghij") for _ in range(130))
    around = ["".join(rng.choice("klmnop") for _ in range(60)) for _ in range(12)]
    docs = [(i, rng.choice(around)[: rng.randrange(60)] + passage[: rng.choice([80, 101, 130])] + rng.choice(around)[rng.randrange(60) :] + str(i % 7)) for i in range(400)]
    expected = Counter((k, *v) for k, v in suffix_dedup.brute_force(docs).items())
    assert sum(n for (_, _, n, _, _), c in expected.items()) > 0
    for hot in (2, 20, 10_000):
        assert repeats(frame(spark, docs), hot=hot, block_bytes=1 << 12) == expected
    with pytest.raises(ValueError, match="width"):
        suffix_dedup.find_repeats(frame(spark, docs), width=250)


@pytest.mark.parametrize("budget", [1 << 10, 1 << 14])
def test_a_shard_several_times_its_budget(tmp_path, budget, monkeypatch):
    """The queues spill: most tuples of a sort go through files."""
    rng = random.Random(11)
    base = [bytes(rng.randrange(97, 101) for _ in range(700)) for _ in range(30)]
    pieces = [rng.choice(base)[rng.randrange(300) :] for _ in range(300)]
    spilled = []
    spill = induced_sort.Spool.spill
    monkeypatch.setattr(induced_sort.Spool, "spill", lambda self: spilled.append(sum(len(p) for p, _ in self.held)) or spill(self))
    s, order, _ = sort_pieces(pieces, tmp_path, budget)
    assert sum(spilled) > len(s) / 2 and sorted(order) == list(range(len(s)))
    end = [s.index(0, i) for i in order[:: 97]]
    keys = [tuple(s[a : min(e, a + 100)]) for a, e in zip(order[::97], end)]
    assert keys == sorted(keys)


def test_repeats_of_odd_rows(spark):
    docs = [*ODD, (None, LONG), (None, None)]
    got = suffix_dedup.find_repeats(frame(spark, docs)).collect()
    assert len(got) == len(docs) and sum(r.n_removed for r in got) >= len(LONG) and {r.n_removed for r in got if r.doc_id == 6} != {len(LONG)}
    assert suffix_dedup.find_repeats(frame(spark, docs).limit(0)).count() == 0
    both = frame(spark, [(5, "q" + "w" * 3 + LONG[:150]), (5, "e" + LONG[:150])])
    assert sorted(r.n_removed for r in suffix_dedup.find_repeats(both).collect()) == [0, 150]
    docs = [(1, "é" * 60 + "first"), (2, "x" + "é" * 60 + " tail"), (3, None)]
    extra = frame(spark, docs).withColumns({"n_removed": F.lit("clash"), "kept": F.lit(1)})
    left = suffix_dedup.remove_repeats(extra)
    assert left.columns == extra.columns
    rows = {r.doc_id: r.text for r in left.collect()}
    assert rows[2].startswith("x") and rows[2].endswith(" tail") and len(rows[2]) < 20 and rows[3] is None


# vectors


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = np.vstack([c + rng.standard_normal((rng.integers(2, 40), 16)) * s for c, s in zip(centres, [0.02, 0.05, 0.08] * 4)] + [rng.standard_normal((200, 16))]).astype(np.float32)
    x = np.vstack([x, x[:25], x[:5] * 3])
    labels = rng.integers(0, 2, len(x))
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, labels)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 16, 0), (9004, [1.0, None] * 8, 0), (9005, [float("nan")] * 16, 0), (9006, x[0].tolist(), None), (9007, x[0][:8].tolist(), int(labels[0])), (None, x[0].tolist(), int(labels[0]))]
    df = frame(spark, rows + odd, "vec_id long, embedding array<float>, label int").withColumn("leaf", F.lit("clash"))
    expected = components(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked))])
    for options in ({}, {"leaf": 20}, {"leaf": 20, "tile": 7}, {"leaf": 10, "trees": 8}):
        got = {r.vec_id: r for r in embed_dedup.near_duplicates(df, **options).collect()}
        assert len(got) == len(rows) + len(odd)
        found = sum(got[i].n_links for i in expected)
        assert found >= 0.95 * linked.sum() and all(got[int(i)].n_links <= n for i, n in zip(ids, linked.sum(axis=1)))
        if not options:
            assert all(got[int(i)].n_links == n for i, n in zip(ids, linked.sum(axis=1))) and {i: got[i].component_id for i in expected} == expected
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd if i is not None)
        assert got[None].component_id is None and not got[None].kept
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0 and embed_dedup.near_duplicates(df.filter("vec_id > 9000")).count() == 7
    kept = embed_dedup.keep_one(df)
    assert kept.columns == df.columns and {r.vec_id for r in kept.collect()} >= set(expected.values()) | {9001}


def test_embeddings_with_labels_of_text_and_ids_of_text(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
    with pytest.raises(ValueError, match="whole numbers"):
        embed_dedup.near_duplicates(df.withColumn("vec_id", F.lit("x")))


def test_lists_of_leaves_take_four_bytes():
    x = np.random.default_rng(0).standard_normal((500, 8))
    assert embed_dedup.Forest(x, 10**9, 5, 384, 0.98, 1.0).kind() == "<u4" and embed_dedup.Forest(x, 10**13, 5, 384, 0.98, 1.0).kind() == "<u8"


def test_double_vectors_and_several_lengths(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [2e300, 2e300], 0), (3, [1e-300, 0.0], 0), (4, [3e-310, 0.0], 0), (5, [1.0, 1.0, 1.0], 0), (6, [2.0, 2.0, 2.0], 0), (7, [1.0, -0.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7)}
    near_one = [(1, [1.0, 0.0], 0), (2, [0.98, float(np.sqrt(1 - 0.98**2)) * (1 + 1e-12)], 0), (3, [0.98 + 1e-9, float(np.sqrt(1 - (0.98 + 1e-9) ** 2))], 0)]
    x = np.array([v for _, v, _ in near_one])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(frame(spark, near_one, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i + 1: int((x[i] @ x.T >= 0.98).sum()) - 1 for i in range(3)}


def test_recall_where_the_sample_does_not_reach_the_leaves(spark):
    """Four levels below those that the sample has rows for; recall against brute force as the contract has it."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((300, 32))
    x = np.vstack([c + rng.standard_normal((10, 32)) * 0.06 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
    forest = embed_dedup.Forest(x[:200], len(x), 5, 6, 0.98, 1.0)
    assert forest.depth == 9 and forest.own == 4
    rows = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(rows, sample=200, leaf=6).collect()}
    assert linked.sum() > 5000 and sum(got.values()) >= 0.95 * linked.sum() and all(got[i] <= n for i, n in enumerate(linked.sum(axis=1)))


# scoring


def tokens_of(text):
    fold = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return [*(text or "").encode().translate(fold).split(), None]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1 << 14}, {"depth": 1, "gain": 2.0}, {"depth": 4, "least": 3, "gain": 1.0, "spread": 0.5}])
def test_scores_by_brute_force(spark, options):
    rng = random.Random(7)
    made = [" ".join(rng.choice(["ab", "Cd", "ef", "gh", "ij é"]) for _ in range(rng.randrange(80))) for _ in range(30)]
    made += [f"{rng.choice('xyz')} the same long passage of words that many texts share {rng.choice('uvw')}" for _ in range(20)]
    docs = [(d["doc_id"], d["text"]) for d in rows_of("documents")[:60]] + list(enumerate(made, 5000)) + [d for d in ODD if d[0] is not None]
    docs = [(i + 10_000 * k, t) for k, (i, t) in enumerate(docs)]
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, docs).repartition(3).withColumn("n", F.lit("clash")), **options).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    expected = lm_scoring.brute_force([(i, t, held[i]) for i, t in docs], **{k: v for k, v in options.items() if k != "block_bytes"})
    c = Counter(w for i, t in docs if not held[i] for w in tokens_of(t))
    n, v = sum(c.values()), len(c)
    apart = 0
    for i, t in docs:
        words, r = tokens_of(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert (r.base_score, r.score) == pytest.approx(expected[i])
        apart += r.score > r.base_score + 1
    assert apart >= 20  # nodes are there


def test_scores_of_held_out_texts_are_above_the_base(spark):
    rows = lm_scoring.digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.1


def test_scores_of_odd_rows(spark):
    got = lm_scoring.score(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.n_tokens for r in got if r.doc_id in (1, 2, 4)} == {1}
    assert lm_scoring.score(frame(spark, ODD).limit(0)).count() == 0
    none = lm_scoring.score(frame(spark, ODD), is_held_out=F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(r.score == r.base_score == 0 and r.n_known == 0 for r in none)


def test_the_states_are_a_distribution():
    """Behind any words, the probabilities of all tokens of training and of one that it lacks sum to one."""
    train = ["a b c", "a b c", "a b d", "x a b c e", "b c", "b a b c"] * 4
    p, nodes = lm_scoring.reference([(i, t, False) for i, t in enumerate(train)], gain=2.0)
    known = {w for t in train for w in lm_scoring._tokens(t)}
    assert {len(c) for c in nodes} >= {1, 2}
    for behind in ((), (b"a",), (b"a", b"b"), (b"q", b"a", b"b"), (b"x", b"a", b"b", b"c"), (b"e",)):
        assert sum(p(behind, w) for w in [*known, b"unseen"]) == pytest.approx(1)


def test_distinct_keys():
    rng = np.random.default_rng(3)
    for hashes in (np.zeros(0, np.uint64), np.array([7], np.uint64), rng.integers(0, 50, 400).astype(np.uint64), rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64), np.repeat(rng.integers(0, 2**64 - 1, 40, dtype=np.uint64), 5), np.array([8, 3, 9, 1, 8, 3], np.uint64)):
        keys = lm_scoring.Keys(hashes)
        distinct, at = np.unique(hashes, return_inverse=True)
        assert (keys.distinct == distinct).all() and (keys.at == at).all()


# the Jaccard join


def shingles(text, k):
    words = tokens_of(text)[:-1]
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def near(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = components(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


@pytest.mark.parametrize("seed, k, num, den", [(0, 3, 90, 100), (1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 50, 100), (4, 2, 70, 100)])
def test_jaccard_by_brute_force(spark, seed, k, num, den):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30 if k == 1 else 400)]
    docs = []
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 10, 20, 60, 300]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, len(words) // 30])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy).upper() if rng.random() < 0.2 else " \t".join(copy))
    docs = list(zip(rng.sample(range(10_000), len(docs)), docs)) + [(20_000, None), (20_001, ""), (20_002, " \n")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(frame(spark, docs).repartition(3).withColumn("tile", F.lit("clash")), k, num, den, block=8).collect()}
    assert got == near(docs, k, num, den)
    if seed in (0, 3):  # by likeliest pairs first
        again = ngram_join.join_components(frame(spark, docs), k, num, den, block=8, few=0)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in again.collect()} == got


def test_jaccard_compares_a_shared_passage_once(spark, monkeypatch):
    """Texts with a passage in common that do not link share tiles; a tile whose pairs have been compared does not come back."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(2)) + " " + passage for _ in range(60)]  # 3 shingles of 30 are the text's own: none links
    near = [f"n{i}" for i in range(60)]
    for i in range(120):  # near copies, of which some link
        own = list(near)
        for j in range(1 + i % 3):
            own[rng.randrange(58)] = f"x{i}{j}"
        texts.append(" ".join(own))
    docs = list(enumerate(texts))
    opened, write = [], ngram_join.written

    def counted(df, name):
        made = write(df, name)
        if name == "open":
            opened.append({r.tile for r in made.select("tile").distinct().collect()})
        return made

    monkeypatch.setattr(ngram_join, "written", counted)
    sets = {i: {" ".join(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs}
    want = components(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    for options in ({"few": 0}, {"few": 0, "block": 16}, {}):
        opened.clear()
        got = {r.doc_id: r.component_id for r in ngram_join.join_components(frame(spark, docs), **options).collect()}
        assert got == want
        if options == {"few": 0}:
            assert opened[0] and all(later <= first for first, later in zip(opened, opened[1:])) and (len(opened) < 2 or len(opened[1]) < len(opened[0]))


def test_jaccard_of_odd_rows(spark):
    got = ngram_join.join_components(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id is None} == {None} and {r.component_id for r in got if r.doc_id == 5} == {5}
    assert ngram_join.join_components(frame(spark, ODD).limit(0)).count() == 0
    docs = frame(spark, [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (9, None)]).withColumn("n", F.lit("clash"))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 9]


def test_which_of_repeated_rows_stays_is_fixed(spark):
    rows = [(1, "a b c d e f g", f"row {i}") for i in range(12)] + [(2, "a b c d e f g", "copy"), (3, "other words are in this one", "x")]
    kept = set()
    for seed, parts in ((0, 1), (1, 5), (2, 3)):
        order = random.Random(seed).sample(rows, len(rows))
        got = ngram_join.keep_one(spark.createDataFrame(order, "doc_id long, text string, _of string").repartition(parts)).collect()
        assert sorted(r.doc_id for r in got) == [1, 3]
        kept.add(next(r._of for r in got if r.doc_id == 1))
    assert len(kept) == 1


def test_word_hashes():
    texts = [b"Ab  cd\tef", b"", b"abcdefgh abcdefghi abcdefgh\n", "é É".encode()]
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [3, 0, 3, 2] and hashes[3] == hashes[5] and len(set(hashes.tolist())) == 7
    assert word_hashes([b"ab"])[0][0] == hashes[0] and word_hashes([b" "])[1].tolist() == [0]


def test_tiles_are_shared_by_all_that_link():
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for n in (1, 2, 5, 9, 10, 11, 19, 20, 40, 100, 333, 1000):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(10):
                inter = int(rng.integers(1, n + 1))
                b = np.unique(np.concatenate((rng.choice(a, inter, replace=False), rng.integers(0, 2**63, int(rng.integers(0, n + 1))).astype(np.uint64))))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both):
                    assert len(np.intersect1d(ngram_join.tiles(a, num, den), ngram_join.tiles(b, num, den)))
