"""Every operator's query against its SQL, and the pipeline over whole tables."""

import pytest

from logweir.llm.queries import ORACLES, QUERIES
from tests.compare import database, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, db, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(db, ORACLES[name])


def test_pipeline_and_contract(spark):
    import __spark_entry__ as contract
    import corpus_pipeline

    assert {"pipeline", *QUERIES} <= set(contract.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "quality_classifier", "near_duplicates", "repeated_strings", "packing",
    ]
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 50
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_token_files_against_the_library(spark):
    """Every document of the table: what is read back is what the library encodes."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    from logweir.llm.tokens import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    start, want = 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = QUERIES["op13_seekable_frames"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_whitening_against_numpy(spark):
    import numpy as np

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    values, components = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, components = values[::-1], components[:, ::-1]
    white = ((x - fit.mean(axis=0)) @ components[:, :4]) / np.sqrt(values[:4])
    deviation = ((len(fit) * x - fit.sum(axis=0)) ** 2).sum(axis=1)
    place = {r.vec_id: k for k, r in enumerate(rows)}
    got = QUERIES["op12_cholesky_jacobi"](spark, SF).collect()
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        k, c = place[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (len(fit), deviation[k]) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
        sign = signs.setdefault(c, np.sign(r.whitened * white[k, c]))
        assert r.whitened == pytest.approx(sign * white[k, c], abs=1e-9)


def test_empty_tables(spark, tmp_path):
    """Without rows the new queries return none, with the columns that they have otherwise."""
    for name in ("documents", "embeddings", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("op4_uniform_threshold", "op11_dual_tree", "op12_cholesky_jacobi", "op13_seekable_frames"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []
