"""All queries and the pipeline over tables of awkward rows, and over empty ones."""

import pytest

import corpus_pipeline
from logweir.llm.queries import QUERIES
from tests.llm.llm_helpers import documents, rows


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Folders of tables: nulls, ties, repeated rows and clashing columns; and the same without rows."""
    vectors = [(i, [float(i % 7), 1.0 - i, 0.5 * (i % 3)], 1) for i in range(45)]
    vectors += [(20, [1.0, 2.0, 3.0], 1), (20, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0, 1.0], 1), (50, None, 1)]
    vectors += [(51, [], 1), (52, [None, 1.0, 2.0], 1), (60, [float("nan"), 1.0, 2.0], 1), (61, [1.0], 1), (80, [3e38, -3e38, 0.0], None)]
    said = [(1, k, "u", f"line {k}\nsecond {k % 2}") for k in range(6)]
    said += [(1, 2, "u", "line 2\nsecond 0"), (None, 1, None, "x"), (2, None, "u", "y"), (2, 1, None, None), (2, 2, "u", "")]
    items = [(1, "the text without an id and"), (1, "and"), (None, "two one"), (2, None), (3, "")]
    tables = {
        "documents": documents(spark),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int"),
        "embeddings": spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").selectExpr(
            "*", "1 as x", "2 as v", "'r' as rank", "0 as query_id", "1 as n", "'d' as block"),
        "conversations": spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").selectExpr(
            "*", "'s' as said", "1 as c", "2 as t", "'m' as mail", "3 as at", "4 as lines", "5 as conv"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as row", "'t' as terms", "0 as score"),
    }
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "none"))
    for name, table in tables.items():
        table.write.parquet(f"{full}/{name}.parquet")
        table.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


#: Queries with a row for each document, or each message.
EACH = {n: len(rows()) for n in QUERIES if n.split("_")[0] in ("op2", "op3", "op5", "op6", "op7", "op8", "op10", "op13")} | {
    "op9_quotation_links": 11
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, folders, name):
    full, empty = folders
    found = QUERIES[name](spark, full)
    assert len(set(map(str.lower, found.columns))) == len(found.columns)
    n = len(found.collect())
    assert n == EACH.get(name, n) and n > 0
    none = QUERIES[name](spark, empty)
    assert none.columns == found.columns and none.collect() == []


def test_pipeline(spark, folders):
    full, empty = folders
    pieces = corpus_pipeline.run(spark, full).collect()
    assert {r.doc_id for r in pieces} <= {r[0] for r in rows()}
    assert corpus_pipeline.run(spark, empty).collect() == []
