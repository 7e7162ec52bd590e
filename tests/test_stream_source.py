import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.sources.store import commits, read_documents


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_of_one_or_many_files_is_streamed(spark, tmp_path, files):
    """``files`` 0: the table is a file, else a folder of that many; the judged rows come by the stream either way."""
    rows = spark.createDataFrame(
        [(i, f"line {i}\nrest of {i}", "en", "src0", 9) for i in range(12)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    place = tmp_path / "documents.parquet"
    if files:
        rows.repartition(files).write.parquet(str(place))
    else:
        rows.toPandas().to_parquet(place, index=False)
    (tmp_path / "other.parquet").mkdir()
    rows.withColumn("doc_id", F.col("doc_id") + 100).write.mode("append").parquet(str(tmp_path / "other.parquet"))
    rows.filter("doc_id < 5").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(
        str(tmp_path / "labels.parquet")
    )
    path = entry._streamed(spark, str(tmp_path))
    assert sorted(r.doc_id for r in read_documents(spark, path).select("doc_id").collect()) == list(range(12))
    assert [(row.batch.startswith("stream-"), row.n_docs) for row in commits(spark, path)] == [(True, 5), (False, 7)]
