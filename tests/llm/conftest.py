import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

TINY = "/root/testdata/sf0.001"


@pytest.fixture
def tiny():
    if not os.path.isdir(TINY):
        pytest.skip("no test tables")
    return TINY


@pytest.fixture
def documents(spark):
    """documents from (doc_id, text[, lang, source]) rows, with extra columns whose names clash with results."""

    def make(rows):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        full = [(*r, len(r[1]) if r[1] is not None else None, 7, "x", 1.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words int, labels string, score double")

    return make


@pytest.fixture
def folder(tmp_path):
    def save(**tables):
        for name, columns in tables.items():
            pq.write_table(pa.table(columns) if isinstance(columns, dict) else columns, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return save
