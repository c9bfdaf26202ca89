"""Queries that take all rows of their tables."""

from stratalore.plans.queries import QUERIES


def test_best_chunk_of_every_document_has_no_limit(spark, sf):
    best = QUERIES["best_chunk_per_doc"](spark, sf)
    assert best.count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert "GlobalLimit" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_file_kinds_of_every_page(spark, tmp_path):
    kinds = {"a.html": "code", "a.pdf": "pdf", "a.json": "json", "a.txt": "text", "a.md": "markdown", "a.PY": "code", "a.zip": "unknown", "a": "unknown"}
    urls = list(enumerate(kinds))
    spark.createDataFrame([(i, f"http://h/{u}", "") for i, u in urls], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.kind for r in QUERIES["file_kinds"](spark, str(tmp_path)).collect()}
    assert got == {i: kinds[u] if "." in u else "unknown" for i, u in urls}
