from tessera.functions.text import sorted_key
from tessera.streaming.intake import keyed_entities, retrieve


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-1", "x", "b a"), ("S1-2", "x", "c"), ("S1-3", "y", "a b"), ("S1-4", "x", "c")], "entity_id string, country string, n_core string")
    pool = spark.createDataFrame([("S2-1", "x", "a b"), ("S2-2", "x", "c"), ("S3-1", "y", "b a"), ("S3-2", "x", "")], "entity_id string, country string, n_core string")
    pool.write.parquet(f"{tmp_path}/in")
    entities = keyed_entities(s1, sorted_key("n_core"), 1)
    want = sorted(map(tuple, retrieve(pool, entities, sorted_key("n_core")).collect()))
    stream = retrieve(spark.readStream.schema(pool.schema).parquet(f"{tmp_path}/in"), entities, sorted_key("n_core"))
    q = stream.writeStream.format("memory").queryName("intake").option("checkpointLocation", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("intake").collect())) == want == [("S1-1", "S2-1"), ("S1-3", "S3-1")]
