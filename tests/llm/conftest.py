import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("fp", T.StringType()),  # extra columns whose names clash with inner ones
        T.StructField("size", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("_t", "_id", "_h", "_row", "_size", "t", "id", "n", "sig", "row", "cluster", "lang_pred", "lang_score", "lang_distance", "h", "w", "keys")],
    ]
)


@pytest.fixture
def make_docs(spark, tmp_path):
    """Writes rows (doc_id, text, lang, source) as a documents table and returns the folder."""

    def write(rows):
        full = [(*r, *(["en", "s"][len(r) - 2 :] if len(r) < 4 else []))[:4] + (len(r[1] or ""), "x", "y") + tuple("abcdefghijklmnopq") for r in rows]
        spark.createDataFrame(full, DOCS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write
