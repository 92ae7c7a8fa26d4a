import json

import pytest

from latchgraph.operators import render
from latchgraph.plans.analyze import analyze

from projects import PROJECTS


@pytest.fixture(scope="module")
def outcome(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("projects")
    paths = {}
    for name, (files, *_) in PROJECTS.items():
        for path, text in files.items():
            (base / name / path).parent.mkdir(parents=True, exist_ok=True)
            (base / name / path).write_text(text)
        paths[name] = str(base / name)
    return analyze(spark, list(paths.values())), paths


@pytest.mark.parametrize("name", PROJECTS)
def test_project(outcome, name):
    out, paths = outcome
    _, code, diagnostics, warnings = PROJECTS[name]
    root = paths[name]
    if code < 2:
        report = out.reports[root]
        found = [(d["code"][-3:], d["primary_location"]["file"], d["primary_location"]["line"], d["primary_location"]["column"], " > ".join(x["function"] for x in d["chain"])) for d in report["diagnostics"]]
        assert found == diagnostics
        assert [w["message"] for w in report["warnings"]] == warnings
    assert out.exit_codes[root] == code


def test_fatal_messages(outcome):
    out, paths = outcome
    assert out.errors[paths["bad_strategy"]] == "Invalid strategy: must be 'first-party-deepest' or 'async-boundary'"
    assert "No analyzable source files" in out.errors[paths["no_sources"]]
    assert out.exit_code == 3


def test_whole_report(outcome):
    # fixed values: fields and texts of the report
    out, paths = outcome
    assert json.loads(render.as_json(out.reports[paths["transitive"]])) == {
        "version": "1.0",
        "diagnostics": [
            {
                "code": "LATCH002",
                "severity": "error",
                "message": "Transitive blocking call reachable from async context",
                "primary_location": {"file": "main.py", "line": 5, "column": 14},
                "related_locations": [
                    {"file": "main.py", "line": 8, "column": 11, "message": "async function listing defined here"},
                    {"file": "main.py", "line": 3, "column": 1, "message": "names defined here"},
                    {"file": "main.py", "line": 5, "column": 14, "message": "blocking call: glob.glob"},
                ],
                "chain": [
                    {"function": "listing", "file": "main.py", "line": 8, "is_async": True, "is_first_party": True},
                    {"function": "names", "file": "main.py", "line": 3, "is_async": False, "is_first_party": True},
                    {"function": "glob.glob", "file": None, "line": None, "is_async": False, "is_first_party": False},
                ],
                "help": "Wrap the blocking call in `await asyncio.to_thread(...)` or use async alternative",
                "intervention_strategy": "first-party-deepest",
            }
        ],
        "warnings": [],
    }


def test_property_and_dunder_texts(outcome):
    out, paths = outcome
    (prop, _), (dunder,) = (out.reports[paths[n]]["diagnostics"] for n in ("property", "dunder"))
    assert prop["message"] == "Async function 'job' accesses blocking property 'Feed.rows'"
    assert [x["message"] for x in prop["related_locations"]] == ["async function job defined here", "property getter defined here"]
    assert dunder["message"] == "Async function 'job' calls blocking dunder method 'Far.__str__'"
    assert dunder["related_locations"][1] == {"file": "main.py", "line": 4, "column": 9, "message": "dunder method defined here"}
    stub = out.reports[paths["stub"]]["diagnostics"][0]
    assert stub["related_locations"][-1]["message"] == "outside.grind marked blocking with @blocking in stub"
    assert out.reports[paths["boundary"]]["diagnostics"][0]["severity"] == "warning"


def test_text_and_sarif(outcome):
    out, paths = outcome
    text = render.as_text(out.reports[paths["direct"]])
    assert text == "main.py:4:9: error LATCH001: Direct blocking call to 'shutil.rmtree' in async function 'purge'\n  help: Wrap in `await asyncio.to_thread(...)` or use async alternative\n"
    assert render.as_text(out.reports[paths["sync_only"]]) == "No blocking issues found\n"
    assert "warning: bad.py: Syntax error in bad.py\n" in render.as_text(out.reports[paths["syntax_error"]])
    sarif = json.loads(render.as_sarif(out.reports[paths["transitive"]]))
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 4
    assert [r["id"] for r in run["results"][0]["relatedLocations"]] == [1, 2, 3]
    assert run["results"][0]["codeFlows"][0]["threadFlows"][0]["locations"][-1]["location"]["physicalLocation"]["artifactLocation"]["uri"] == "<external>"


def test_tables(outcome):
    out, paths = outcome
    statuses = {(r["project"], r["id"]): r["status"] for r in out.statuses().collect()}
    assert statuses[paths["transitive"], "main.py:names"] == "PropagatedBlocking"
    assert statuses[paths["calm_in_cycle"], "main.py:calm"] == "KnownNonBlocking"
    handed = out.graph.edges.filter("in_executor").select("project", "dst", "protected").collect()
    assert (paths["safe_and_unsafe"], "main.py:matches", True) in [tuple(r) for r in handed]
    members = {r["id"]: r["scc"] for r in out.components().filter(f"project = '{paths['calm_in_cycle']}'").collect()}
    assert members["main.py:calm"] == members["main.py:loud"] == "main.py:calm"


def test_ranked_and_shortest_reasons(outcome):
    """Every node's first reason by rank is the one that the linear loop finds."""
    out, _ = outcome
    ranked = out.ranked().filter("rank = 1")
    key = lambda r: (r["project"], r["node"], r["root"], [tuple(x) for x in r["chain"]])
    first = sorted((key(r) for r in ranked.collect()), key=str)
    assert first and first == sorted((key(r) for r in out.shortest().collect()), key=str)


def test_documents_of_any_size(outcome, tmp_path):
    """What executors write is what is made in memory, for each project and for all together."""
    out, paths = outcome
    for kind, whole in render.FORMATS.items():
        lines = {}
        for r in render.ordered_pieces(out.pieces(kind)).collect():
            lines.setdefault(r["document"], []).append(r["text"] + "\n")
        assert {k: "".join(v) for k, v in lines.items()} == {root: whole(r) for root, r in out.reports.items()}
    every = list(out.reports.values())
    merged = {"version": every[0]["version"], "diagnostics": [d for r in every for d in r["diagnostics"]], "warnings": [w for r in every for w in r["warnings"]]}
    assert "".join(r["text"] + "\n" for r in render.ordered_pieces(out.pieces("json", together=True)).collect()) == render.as_json(merged)
    out.write("sarif", str(tmp_path / "out"))
    folders = {f.name: "".join(p.read_text() for p in sorted(f.glob("part-*"))) for f in (tmp_path / "out").iterdir() if f.is_dir()}
    assert sorted(folders.values()) == sorted(render.as_sarif(r) for r in out.reports.values())
