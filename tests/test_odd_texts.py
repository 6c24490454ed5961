"""Queries against their SQL on documents without text, time or grams, and with white space beyond ASCII."""

import duckdb
import pytest

from retrace.operators import ordered
from test_queries import QUERIES, SQL, canonical

TEXTS = [None, "", " \t\n ", "abc", "abcd", "abcde", "", " ", "a b\fc\rdef", "a\x0bbcdefg", "a　b cdef", "x\x1cyz\x85abc",
         "\U0001f600\U0001f601 a\U0001f602bc", "aaaa aaaa", "abcde", None, "the quick fox", "the quick fix"]


@pytest.mark.parametrize("rows_of_a_slice", [1000, 3])
def test_neighbours_of_odd_texts(spark, monkeypatch, tmp_path, rows_of_a_slice):
    rows = [(i, text, "en", source, 1) for j, source in enumerate(["a", "b", None]) for i, text in enumerate(TEXTS[j:], 20 * j)]
    rows += [(None, "no time", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = ordered.Ordered.of
    monkeypatch.setattr(ordered.Ordered, "of", staticmethod(lambda df, keys, order, by=None, slice_rows=0, like=None: plain(df, keys, order, by, rows_of_a_slice, like)))
    df = QUERIES["adjacent_similarity"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(SQL["adjacent_similarity"])
    want = canonical(cursor.fetchall(), [d[0] for d in cursor.description])
    assert repr(canonical([tuple(r) for r in df.collect()], df.columns)) == repr(want)  # as text, for NaN equals nothing
