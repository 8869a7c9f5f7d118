"""Members that arrive in pieces, as a stream of files."""

from stowage.streaming import volumes as V


def test_split_members(spark, tmp_path, only_data_batches):
    rows = [(1, 2, b"c", True), (1, 0, b"a", False), (2, 0, b"x", True), (3, 1, b"z", True)], [(1, 1, b"b", False), (1, 0, b"a", False)]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, V.PIECES).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(V.PIECES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = V.join_stream(stream).writeStream.format("memory").queryName("split_members").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
        found = sorted((r.set_id, r.volumes, bytes(r.payload)) for r in spark.table("split_members").collect())
        assert found == [(1, 3, b"abc"), (2, 1, b"x")]
    finally:
        q.stop()


def test_walk_split():
    assert V.walk_split({}, None, [(0, b"", True)]) == (b"", {}, None)
    assert V.walk_split({1: b"b"}, 1, [(1, b"other", False)]) == (None, {1: b"b"}, 1)
    assert V.walk_split({1: b"b"}, 1, [(0, b"a", False)]) == (b"ab", {}, None)
