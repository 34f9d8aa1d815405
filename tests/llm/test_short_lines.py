"""Short lines that repeat, in op9_dedup_lines."""

from presslens.llm import line_dedup, queries


def test_equal_short_lines_go(spark, tmp_path):
    docs = [(1, "Les.\n\nof it\na line that is long enough"), (2, "  Les. \nLes!\n\nof  it"), (3, "a line that is long enougH\nx\nx\n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.removed for r in queries.op9_dedup_lines(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 3], 3: [0, 2]}  # equal ones only ('Les!' stays), empty ones never
    kept = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), equal=5)
    assert {r.doc_id: r.removed for r in kept.collect()} == {1: [], 2: [3], 3: [0]}
