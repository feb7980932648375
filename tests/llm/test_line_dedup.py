"""Line dedup against a plain count of lines."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from textloom.llm import line_dedup, queries

SF = "/root/testdata/sf0.01"


def brute(rows, min_docs=3, min_chars=20):
    """(doc_id, text) in; (n_lines, kept lines) out, a row each."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    gone = lambda i, line: i is not None and len(held.get(key(line), ())) >= min_docs and i != max(held[key(line)])
    return [(len((text or "").split("\n")), [x for x in (text or "").split("\n") if not gone(i, x)]) for i, text in rows]


def check(spark, rows, schema="doc_id long, text string"):
    want = sorted((str(r[0]), n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for r, (n, kept) in zip(rows, brute(rows)))
    got = line_dedup.digest(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want


LINE = "a line that is long enough, twice over"


def test_cases(spark):
    rows = [
        (1, LINE + "\nshort\n" + LINE.upper()), (2, f"\t {LINE}\r\n\n{LINE}"), (3, LINE + "\n"), (4, None), (5, ""), (6, "\n\n"),
        (7, "ÉCOUTEZ bien cette phrase-là\nx"), (8, "Écoutez bien cette phrase-là"), (9, "École Écoutez BIEN cette\nÉcoutez bien CETTE phrase-là"), (10, "Écoutez bien cette phrase-là"),
        (11, "nineteen characters\nnineteen characters"), (12, "nineteen characters"), (13, "nineteen characters"),
        (14, "in two documents only, so it stays"), (15, "in two documents only, so it stays\nin two documents only, so it stays"),
    ]
    check(spark, rows)


def test_repeated_and_missing_ids(spark):
    rows = [(1, LINE), (1, LINE), (1, LINE + "\nmore"), (2, "y\n" + LINE), (None, LINE), (None, "z"), (2, "y\n" + LINE)]
    check(spark, rows)  # two documents
    check(spark, rows + [(3, LINE + "\n" + LINE), (3, "w\n" + LINE)])  # three; both rows of the last keep it
    check(spark, [(None if i is None else f"d{i}", t) for i, t in rows + [(3, LINE)]], "doc_id string, text string")


def test_empty_table(spark):
    assert line_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_lines_go(spark):
    got = {r.doc_id: r for r in line_dedup.keep_bitmaps(spark.createDataFrame([(i, f"{LINE}\n{LINE}") for i in range(4)], "doc_id long, text string")).collect()}
    assert (got[0].n_lines, got[0].n_dropped, got[0].keep) == (2, 2, [0, 2]) and (got[3].n_dropped, got[3].keep) == (0, [2])


def test_bitmaps_are_runs(spark):
    texts = [(1, "a\n" + LINE + "\nb\nc\n" + LINE + "\n" + LINE), (2, LINE), (3, LINE)]
    got = {r.doc_id: r.keep for r in line_dedup.keep_bitmaps(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [1, 1, 2, 2], 2: [0, 1], 3: [1]}


def test_apply_keeps_columns(spark):
    names = ["id", "part", "pos", "h1", "h2", "gone", "keep", "row", "n_lines", "doc_id", "text"]
    df = spark.createDataFrame([(*range(9), i, t) for i, t in [(1, "a\n" + LINE), (2, LINE), (3, LINE), (4, None)]], ", ".join(f"{n} long" for n in names[:-1]) + ", text string")
    out = line_dedup.apply(df)
    assert out.columns == names
    assert {r.doc_id: (r.text, r.h1) for r in out.collect()} == {1: ("a", 3), 2: ("", 3), 3: (LINE, 3), 4: (None, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_with_a_hot_line(spark, seed):
    rng = random.Random(seed)
    pool = [f"{w} line number {i:03d} of the pool" for i, w in enumerate(rng.choices(["One", "TWO", "drei é"], k=60))]
    rows = []
    for i in range(300):
        lines = [rng.choice(pool) if rng.random() < 0.3 else f"only here {i} {k} and nowhere else" for k in range(rng.randint(0, 6))]
        if i % 3:
            lines += [LINE] * rng.randint(1, 30)
        rng.shuffle(lines)
        rows.append((i, "\n".join(rng.choice((x, x.upper() if x.isascii() else x, x + "\t")) for x in lines)))
    assert line_dedup.hot_keys(line_dedup.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 20), 64) is not None
    check(spark, rows)


def test_long_text(spark):
    many = "\n".join(LINE if k % 2 else f"row {k} of a long document" for k in range(40_000))
    rows = [(1, many), (2, LINE), (3, LINE), (4, "x" * 3_000_000)]
    check(spark, rows)


def test_parameters(spark):
    df = spark.createDataFrame([(1, "word\nb"), (2, "word")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.apply(df, min_docs=2, min_chars=4).collect()} == {1: "b", 2: "word"}
    with pytest.raises(ValueError):
        line_dedup.apply(df, min_docs=1)


def test_main_path_is_native(spark):
    plan = queries.op11_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "rangepartitioning(h1" in plan and plan.count("Window") >= 2


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({queries.oracle_sql()['op11_lines']})").fetchall()
    assert sorted(map(tuple, queries.op11_lines(spark, SF).collect())) == sorted(want)
