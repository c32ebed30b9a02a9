import os
import tempfile

import pytest
from pyspark.sql import Row

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from texts or (id, text[, source]) rows."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = (i, row, "a") if row is None or isinstance(row, str) else (*row, "a")[:3]
            full.append(Row(doc_id=doc_id, text=text, lang="en", source=source, n_chars=len(text or "")))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture
def saved(spark):
    """Writes tables into a folder of their own, for queries that take one."""

    def save(**tables):
        folder = tempfile.mkdtemp(prefix="tables-")
        for name, df in tables.items():
            df.write.parquet(os.path.join(folder, f"{name}.parquet"))
        return folder

    return save
