"""Queries without a DuckDB equivalent take every document and card, whatever its id."""

from datetime import date

import pytest

from folio.plans import registry


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    text = "A first line that is long enough\nand goes on here\nshort"
    spark.createDataFrame([(i, text, "en", "src1", len(text)) for i in (5, 5000)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, date(1995, 1, 1)) for i in (5, 5000)], "l_orderkey long, l_linenumber int, l_shipdate date").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize(("name", "key"), [("C04_paragraphs", "book"), ("C22_stitched_pages", "book"), ("C17_merged_fragments", "book"), ("ST08_replay", "item_id")])
def test_every_id(spark, sf, name, key):
    rows = [r.asDict() for r in registry.queries()[name](spark, sf).collect()]
    found = {i: sorted(repr({c: v for c, v in r.items() if c != key}) for r in rows if r[key] == i) for i in (5, 5000)}
    assert found[5] and found[5] == found[5000]
