from __future__ import annotations

from maskwright.operators.detect import mask
from maskwright.streaming.masking import latest, mask_into


def test_a_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = [(1, "soy Ana Prieto, a@b.com"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    docs.write.parquet(f"file://{tmp_path}/in")
    for more in (0, 1):  # the second run finds the new file only
        if more:
            spark.createDataFrame([(4, "c@d.org")], docs.schema).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(docs.schema).parquet(f"file://{tmp_path}/in")
        mask_into(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
        got = spark.read.parquet(f"file://{tmp_path}/out")
        want = mask(spark.read.parquet(f"file://{tmp_path}/in"))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_the_latest_revision_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, None)], "id int, revision int, text string")
    assert sorted(map(tuple, latest(rows, ["id"]).collect()), key=str) == [(1, 3, "c"), (2, 1, None)]
