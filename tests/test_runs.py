"""Cache, command line, repeated runs, continuous analysis."""

import json

from latchgraph.__main__ import main
from latchgraph.operators.callgraph import snapshot
from latchgraph.plans.analyze import Options, analyze
from latchgraph.sources import cache, files
from latchgraph.sources.config import load, parse
from latchgraph.streaming.watch import watch

BLOCKING = "import time\n\ndef pause():\n    time.sleep(1)\n\nasync def job():\n    pause()\n"


def test_cache(spark, tmp_path):
    (tmp_path / "main.py").write_text(BLOCKING)
    (tmp_path / "other.py").write_text("x = 1\n")
    root, options = str(tmp_path), Options(cache_enabled=True)
    cold = analyze(spark, [root], options).reports[root]
    config = load(root)
    found = files.read(spark, [config])
    assert cache.diff(spark, found, config.cache_dir).count() == 0
    warm = analyze(spark, [root], options).reports[root]
    plain = analyze(spark, [root]).reports[root]
    assert cold == warm == plain and len(cold["diagnostics"]) == 1
    (tmp_path / "other.py").write_text("import time\n\nasync def more():\n    time.sleep(1)\n")
    (tmp_path / "new.py").write_text("y = 1\n")
    assert {(r["path"], r["change"]) for r in cache.diff(spark, files.read(spark, [config]), config.cache_dir).collect()} == {("other.py", "changed"), ("new.py", "added")}
    assert len(analyze(spark, [root], options).reports[root]["diagnostics"]) == 2
    cache.clear(config.cache_dir)
    assert cache.diff(spark, found, config.cache_dir) is None


def test_repeated_runs_agree(spark, tmp_path):
    (tmp_path / "main.py").write_text(BLOCKING)
    a, b = (analyze(spark, [str(tmp_path)]) for _ in range(2))
    assert a.reports == b.reports
    lines = [sorted(r["line"] for r in snapshot(x.graph).collect()) for x in (a, b)]
    assert lines[0] == lines[1] and any("edge main.py:job -> main.py:pause DirectCall" in x for x in lines[0])


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "main.py").write_text(BLOCKING)
    assert main(["check", str(tmp_path), "--no-cache", "--output", "json", "--severity", "warning"]) == 1
    out = json.loads(capsys.readouterr().out)
    assert out["version"] == "1.0" and out["diagnostics"][0]["severity"] == "warning"
    assert main(["check", str(tmp_path), "--no-cache", "--python-version", "2.7"]) == 2
    assert "Invalid python_version" in capsys.readouterr().err
    assert main(["check", str(tmp_path / "none")]) == 2


def test_bounds_are_reported(spark, tmp_path):
    (tmp_path / "main.py").write_text(BLOCKING)
    out = analyze(spark, [str(tmp_path)], Options(max_chain_length=1)).reports[str(tmp_path)]
    assert not out["diagnostics"] and "some may be missing" in out["warnings"][0]["message"]


def test_watch(spark, tmp_path):
    config = parse("", "p")
    arriving, seen = tmp_path / "in", []
    arriving.mkdir()
    note = lambda out: seen.append(out.diagnostics.count())
    (arriving / "1.json").write_text(json.dumps({"project": "p", "path": "main.py", "text": BLOCKING}) + "\n")
    watch(spark, str(arriving), [config], str(tmp_path / "state"), note).awaitTermination()
    (arriving / "2.json").write_text(json.dumps({"project": "p", "path": "main.py", "text": "async def job():\n    pass\n"}) + "\n")
    watch(spark, str(arriving), [config], str(tmp_path / "state"), note).awaitTermination()
    # of two versions in one batch the last one counts, and older states go
    lines = [{"project": "p", "path": "main.py", "text": t} for t in ("async def job():\n    pass\n", BLOCKING, "x = 1\n", BLOCKING)]
    (arriving / "3.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    watch(spark, str(arriving), [config], str(tmp_path / "state"), note).awaitTermination()
    assert seen == [1, 0, 1]
    assert sorted(x.name for x in (tmp_path / "state").iterdir() if x.name.isdigit()) == ["000000000001", "000000000002"]
