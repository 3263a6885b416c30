from codexweave.operators.facts import mentions
from codexweave.streaming import mentions as stream


def test_batches_add_up_to_the_whole(spark, tmp_path):
    names = spark.createDataFrame([("宝玉", "宝玉"), ("x", "来")], "name string, term string")
    schema, src, out = "id int, text string", str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[(1, "宝玉来"), (2, "无人")], [(3, "来来"), (4, None)], [(5, "宝玉宝玉")]]
    every = spark.createDataFrame([r for p in parts for r in p], schema)
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
        stream.maintain(stream.read_blocks(spark, src, schema, 1), names, ["id"], out, str(tmp_path / "ck")).awaitTermination()
    want = sorted(map(tuple, mentions(every, names, ["id"]).collect()))
    assert sorted(map(tuple, stream.current(spark, out, ["id"]).collect())) == want
