"""The streaming exact match gives the rows of the batch one, and reads no file twice."""

from lonja.operators.catalogue import exact_matches
from lonja.streaming import matched_lines, write_matches


def test_stream_equals_batch(spark, tmp_path):
    master = spark.createDataFrame([(1, ["7", "07"], "a", 1), (1, ["7"], "b", 2), (2, ["9"], "c", 1)], "ruc int, codes array<string>, name string, order int")
    twins = spark.createDataFrame([(1, 2), (2, 1)], "ruc int, other int")
    schema, folder = "ruc int, code string, line int", str(tmp_path / "in")
    parts = [[(1, "7", 1), (1, "007", 2)], [(1, "9", 3), (2, "07", 4), (3, "7", 5), (None, None, 6)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        write_matches(matched_lines(spark, folder, schema, master, twins), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("line", "matched", "kind").collect()))
    batch = exact_matches(spark.createDataFrame(sum(parts, []), schema), master, twins)
    assert got == sorted(map(tuple, batch.select("line", "matched", "kind").collect()))
    # By the rule of two keys: 007 is no code of supplier 1, and for the twin only the code without zeros counts.
    assert got == [(1, "b", "exact"), (2, None, "none"), (3, "c", "exact_equivalent"), (4, "b", "exact_equivalent"), (5, None, "none"), (6, None, "none")]
