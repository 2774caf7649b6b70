from plumbline.streaming import observations as S


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_latest_and_repointed(spark, tmp_path):
    schema = "purl string, ref string, resolved string, observed_at timestamp"
    rows = [("p", "r", "a", "2024-01-01 00:00:00"), ("p", "r", "b", "2024-01-02 00:00:00"), ("q", "s", "a", "2024-01-01 00:00:00")]
    frame = spark.createDataFrame(rows, "purl string, ref string, resolved string, at string").selectExpr("purl", "ref", "resolved", "cast(at as timestamp) AS observed_at")
    frame.coalesce(1).write.parquet(str(tmp_path / "obs"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "obs"))
    got = {r["purl"]: r["resolved"] for r in run(spark, S.latest(stream()), "latest_t", "complete")}
    assert got == {"p": "b", "q": "a"}
    alerts = run(spark, S.repointed(stream()), "moved_t", "append")
    assert [(r["ref"], r["previous"], r["resolved"]) for r in alerts] == [("r", "a", "b")]
    assert len(run(spark, S.deduplicated(stream(), ["purl"]), "once_t", "append")) == 2
    assert run(spark, S.activity(stream()), "act_t", "complete")
