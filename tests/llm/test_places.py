import random

import pytest

from stratalore.llm import places


def test_choice_of_rows_reaches_every_file_and_span(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(places, "SPAN", 16)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), "x" * rng.randrange(50), i, "f", 7) for i in range(500)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id long, text string, n int, file string, row int").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    want = {n for n in range(500) if rng.random() < 0.3}
    got = places.Placed.of(df)
    assert got.df is df
    kept = df.where(df.n.isin(sorted(want))).select(*got.place)
    out = got.only(kept)
    assert out.columns == df.columns and out.schema == df.schema
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == sorted((r for r in rows if r[2] in want), key=lambda r: r[2])
    assert got.only(kept.limit(0)).count() == 0


def test_other_plans_are_written_first(spark):
    df = spark.range(20).selectExpr("id", "id % 3 as _metadata").repartition(2)
    got = places.Placed.of(df)
    assert got.df is not df
    file, row = got.place
    assert got.df.select("id", file, row).distinct().count() == 20
    assert sorted(r.id for r in got.only(got.df.where("id < 5").select(file, row)).collect()) == [0, 1, 2, 3, 4]


def test_a_lost_list_is_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(300).repartition(3).write.parquet(path)
    got = places.Placed.of(spark.read.parquet(path))
    monkeypatch.setattr(places, "fresh_path", lambda spark, name: str(tmp_path / name))
    out = got.only(got.df.where("id < 200").select(*got.place))
    assert out.count() == 200
    lists = sorted((tmp_path / "kept-rows").glob("*.bits"))
    assert len(lists) == 3
    lists[0].unlink()
    with pytest.raises(Exception, match="FileNotFound"):
        out.collect()
