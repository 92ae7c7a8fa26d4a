import pytest

from latchgraph.sources import builtin, config


def parsed(text):
    return config.parse("[tool.latchgraph]\n" + text, "/p")


@pytest.mark.parametrize(
    "text, message",
    [
        ("src_roots = 1", "src_roots must be a list of strings"),
        ("exclude = [1]", "exclude must be a list of strings"),
        ('python_version = "2.7"', "Invalid python_version: must be '3.7'...'3.15'"),
        ("python_version = 3.8", "python_version must be a string"),
        ('severity = "loud"', "Invalid severity: must be 'error' or 'warning'"),
        ('output_format = "xml"', "Invalid output_format: must be 'text', 'json', or 'sarif'"),
        ('intervention_strategy = "x"', "Invalid strategy: must be 'first-party-deepest' or 'async-boundary'"),
        ("cache_enabled = 1", "cache_enabled must be a boolean"),
        ("[tool.latchgraph.blocking]\nadd = 1", "blocking.add must be a list"),
        ("[tool.latchgraph.blocking]\nadd = [1]", "blocking.add entries must be tables"),
        ("[tool.latchgraph.blocking]\nadd = [{help = 'x', category = 'other'}]", "Blocking entry missing required field 'name'"),
        ("[tool.latchgraph.blocking]\nadd = [{name = 'x', help = 'x', category = 'odd'}]", "Unknown category 'odd'. Valid: sleep, network-io, file-io, subprocess, database-io, user-input, other"),
        ("[tool.latchgraph.executor-wrappers]\nx = 1", "Executor wrapper 'x' must be a table"),
        ("[tool.latchgraph.executor-wrappers]\nx = {}", "Executor wrapper 'x' missing required field 'callable_param'"),
        ("[tool.latchgraph.executor-wrappers]\nx = {callable_param = -1}", "Executor wrapper 'x' callable_param must be an integer index or keyword name"),
    ],
)
def test_errors(text, message):
    with pytest.raises(config.ConfigError, match=None) as error:
        parsed(text)
    assert str(error.value) == message


def test_values():
    c = parsed('src_roots = ["src"]\nseverity = "warning"\ncache_dir = "c"\n[tool.latchgraph.executor-wrappers]\n"a.b" = {callable_param = 2}\nd = {callable_param = "f"}\n')
    assert c.src_roots == ("/p/src",) and c.severity == "warning" and c.cache_dir == "/p/c"
    assert c.wrappers == (("a.b", 2, None), ("d", None, "f"))
    assert config.parse("", "/p").intervention_strategy == "first-party-deepest"


def test_roots(tmp_path):
    assert config.load(str(tmp_path)).roots == (str(tmp_path),)
    (tmp_path / "src").mkdir()
    assert config.load(str(tmp_path)).roots == (str(tmp_path / "src"),)
    (tmp_path / "lib").mkdir()
    (tmp_path / "pyproject.toml").write_text('[tool.setuptools.packages.find]\nwhere = ["lib"]\n')
    assert config.load(str(tmp_path)).roots == (str(tmp_path / "lib"),)
    (tmp_path / "pyproject.toml").write_text('[tool.latchgraph]\nsrc_roots = ["gone"]\n')
    with pytest.raises(config.ConfigError, match="does not exist"):
        config.load(str(tmp_path))
    assert config.load(str(tmp_path), None, severity=None, src_roots=(str(tmp_path),)).severity == "error"


def test_builtin_table():
    rows = builtin.rows()
    kinds = [c for _, _, c in rows]
    assert len(rows) == len({n for n, _, _ in rows}) == 61
    assert [kinds.count(c) for c in builtin.CATEGORIES] == [1, 27, 21, 8, 3, 1, 0]
