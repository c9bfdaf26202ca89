import pytest
from pyspark.sql import functions as F

from stratalore.operators import pages as P


@pytest.mark.parametrize("ascending", [True, False])
def test_pages_equal_a_full_sort(spark, ascending):
    rows = [(i, None if i % 50 == 0 else (i * 37) % 100, f"t{i}") for i in range(1000)]
    table = spark.createDataFrame(rows, "id long, created_at long, text string").repartition(5)
    directory = P.PageDirectory.create(table, ascending=ascending, ranges=12)
    assert directory.total == 1000 and directory.pages(7) == 143 and len(directory.ranges) > 5
    want = sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[0]), reverse=not ascending)
    for number in (1, 2, 60, 100, 143, 144):
        assert [tuple(r) for r in directory.page(number, 7).collect()] == want[(number - 1) * 7 : number * 7]
    deep = directory.page(120, 7)
    assert 1 <= len(directory.opened(120, 7)) <= 2
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_range" in plan
    none = P.PageDirectory.create(table.limit(0))
    assert none.page(1) is None and none.pages() == 0


def test_work_goes_on_where_it_stopped(spark, tmp_path):
    seen = []
    path = str(tmp_path)

    def work(rows):
        ids = sorted(r.id for r in rows.collect())
        if seen is not None and ids:
            seen.append(ids)
            if broken and ids[0] >= 4:
                raise RuntimeError("killed")
        return rows.select("id", F.upper("text").alias("enriched"))

    table = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    broken = True
    with pytest.raises(RuntimeError, match="killed"):
        P.catch_up(table([*range(10), None]), "id", work, path, size=4)
    broken = False
    assert P.catch_up(table(range(10)), "id", work, path, size=4, batches=1) == 1
    # Rows that came meanwhile, one of them with a small key, have their turn.
    assert P.catch_up(table([*range(10), 20, -1, -1]), "id", work, path, size=4) == 1
    assert seen == [[0, 1, 2, 3], [4, 5, 6, 7], [4, 5, 6, 7], [-1, -1, 8, 9, 20]]
    done = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/results")
    assert sorted(r.id for r in done.collect()) == [-1, -1, *range(10), 20]
    assert P.catch_up(table(range(10)), "id", work, path) == 0
