"""Every registered training-data query over empty tables, and over tables with nulls in every column."""

import pytest

from bandwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Rows of the odd tables: nulls everywhere, repeats, an id with two texts.
ODD = {
    "documents": [(None, None, None, None, None), (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "other words", None, None, 0), (2, "", "de", None, 0)],
    "labels": [(None, None, None), (1, None, 1), (1, 1, None), (2, 0, 0)],
    "pages": [(None, None, None), (1, "http://a.example.com/x", None), (1, None, "<p>t"), (1, None, "<p>t")],
    "benchmark": [(None, None), (1, "a b c d"), (1, None)],
    "embeddings": [(None, None, None), (None, [1.0, 0.5], 1), (1, None, 1), (1, [2.0, None], 1), (2, [float("nan")], 0), (3, [0.5], None), (3, [0.5], 2), (3, [0.5], 2)],
}


def folder(spark, path, rows):
    for name in ODD:
        schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_odd_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, folder(spark, tmp_path / "empty", {})).count() == 0
    rows = QUERIES[name](spark, folder(spark, tmp_path / "odd", ODD)).collect()
    docs, pages = len(ODD["documents"]), len(ODD["pages"])
    want = {"op5_templates": pages, "op6_urls": pages, "op10_language": docs + pages, "op9_decontamination": 2, "op11_whitening": 4, "op13_hard_negatives": 0}.get(name, docs)
    assert len(rows) == want if name != "pipeline" else len(rows) <= 2
