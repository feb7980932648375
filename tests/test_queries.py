"""Every query of the core engine against its SQL, over the two smallest sizes of the tables."""

import duckdb
import pytest

from textloom.plans import catalogue

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def ducks():
    found = {}
    for sf in (SF, LARGER):
        found[sf] = duckdb.connect()
        for t in TABLES:
            found[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return found


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("sf", [SF, LARGER])
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, ducks, name, sf):
    duck, df = ducks[sf], catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    made = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    assert mine == sorted((tuple(plain(float(v) if type(v).__name__ == "Decimal" else v) for v in r) for r in made), key=repr)


def test_without_sql(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SF).count() > 0


def test_whole_texts_are_encoded(spark, monkeypatch):
    from textloom.operators import encode as E
    from textloom.plans import tiny

    used, made = [], tiny.formula_encoder
    monkeypatch.setattr(tiny, "formula_encoder", lambda *outputs, **settings: used.append(made(*outputs, **settings)) or used[-1])
    assert catalogue.encode_tiny_onnx(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    monkeypatch.undo()
    assert used[0].max_length >= tiny.WHOLE
    tail = spark.createDataFrame([(1, "zz " * 64 + "the " * 9), (2, "zz " * 64)], "id long, text string")
    cut, whole = ({r.id: r.encoding.dense for r in E.encode(tail, e).collect()} for e in (tiny.tiny_encoder(), tiny.tiny_encoder(max_length=tiny.WHOLE)))
    assert cut[1] == cut[2] and whole[1] != whole[2]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
