"""Queries of single texts on a small table of documents: they read the whole text of every one."""

import pytest

import __spark_entry__
from lexspark.functions.text import tokenize

TEXTS = ["first line\nsecond line, (third) word\n\nfirst again", "\n\nonly after breaks", "한 줄이다\n승진 가점을 정한다", "one", "", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_tokens_of_whole_texts(spark, folder):
    got = __spark_entry__.queries()["tokenize_text"](spark, folder).collect()
    assert sorted(map(tuple, got)) == [(i, place, token) for i, t in enumerate(TEXTS) for place, token in enumerate(tokenize(t or ""))]


def test_labels_of_the_documents_own_texts(spark, folder, tmp_path):
    got = __spark_entry__.queries()["script_label"](spark, folder).collect()
    assert sorted(map(tuple, got)) == [(0, "en"), (1, "en"), (2, "ko"), (3, "en"), (4, None), (5, None)]
    odd = ["승진 a", "  ", "12 !!", "plain", "12 !!", "승진 a", "plain", "  "]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["script_label"](spark, str(tmp_path)).collect()
    assert [r.label for r in sorted(got)] == ["ko", None, "other", "en", "other", "ko", "en", None]
