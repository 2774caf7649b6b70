from plumbline import cli


def test_scan_and_report(spark, tmp_path, capsys):
    repo = tmp_path / "repo"
    (repo / ".github/workflows").mkdir(parents=True)
    (repo / "package.json").write_text('{"dependencies": {"a": "1.0.0"}}')
    (repo / ".github/workflows/ci.yml").write_text("jobs: {b: {steps: [{uses: actions/checkout@v4}]}}")
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "scan", str(repo)]) == 0
    run = capsys.readouterr().out.strip().splitlines()[-1]
    assert cli.main([*store, "report", "repo"]) == 0
    out = capsys.readouterr().out
    assert "RISK" in out and "FRONTIER" in out and "unpinned-ref" in out
    assert cli.main([*store, "report", run, "--format", "cyclonedx"]) == 0 and '"specVersion": "1.6"' in capsys.readouterr().out
    assert cli.main([*store, "report", run, "--format", "mermaid"]) == 0 and "flowchart" in capsys.readouterr().out
    assert cli.main([*store, "report", run, "--format", "json"]) == 0
    import json

    document = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert document["run_id"] == run and {"exposure", "findings", "controls", "score", "coverage", "owners"} <= set(document)
    assert {x["reason"] for x in document["coverage"]} >= {"unpinned-ref"}
    snapshots = spark.createDataFrame([(0, "package.json", bytearray(b'{"dependencies": {"a": "1"}}'))], "commit_ord int, path string, content binary")
    snapshots.write.parquet(str(tmp_path / "snapshots"))
    assert cli.main([*store, "history", str(tmp_path / "snapshots")]) == 0 and "added" in capsys.readouterr().out
    assert cli.main([*store, "tools"]) == 0 and "renovate" in capsys.readouterr().out
