"""Project configuration: ``[tool.latchgraph]`` of a pyproject.toml, checked, with defaults."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..names import TOOL
from .builtin import CATEGORIES

VERSIONS = tuple(f"3.{i}" for i in range(7, 16))
STRATEGIES = ("first-party-deepest", "async-boundary")
SEVERITIES = ("error", "warning")
FORMATS = ("text", "json", "sarif")


class ConfigError(Exception):
    """A configuration that cannot be used (exit code 2)."""

    exit_code = 2


class NoSources(Exception):
    """A project without first-party source files (exit code 3)."""

    exit_code = 3


@dataclass(frozen=True)
class Config:
    root: str
    src_roots: tuple[str, ...] | None = None
    exclude: tuple[str, ...] = ()
    stub_paths: tuple[str, ...] = ()
    python_version: str = "3.12"
    intervention_strategy: str = "first-party-deepest"
    severity: str = "error"
    output_format: str = "text"
    cache_dir: str = ""
    cache_enabled: bool = True
    added: tuple[tuple[str, str, str], ...] = ()  # name, help, category
    removed: tuple[str, ...] = ()
    blocking_modules: tuple[str, ...] = ()
    wrappers: tuple[tuple[str, int | None, str | None], ...] = ()  # name, position, keyword
    roots: tuple[str, ...] = field(default=())  # source roots after detection

    def hash(self) -> str:
        """SHA-256 of all settings that a result depends on."""
        return hashlib.sha256(repr(replace(self, cache_dir="", cache_enabled=True, output_format="")).encode()).hexdigest()


def _text(value: object, name: str) -> str:
    if not isinstance(value, str):
        raise ConfigError(f"{name} must be a string")
    return value


def _texts(value: object, name: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{name} must be a list of strings")
    return tuple(value)


def check_version(value: str) -> str:
    if value not in VERSIONS:
        raise ConfigError("Invalid python_version: must be '3.7'...'3.15'")
    return value


def _choice(value: str, allowed: tuple[str, ...], message: str) -> str:
    if value not in allowed:
        raise ConfigError(message)
    return value


def _blocking(table: dict) -> dict:
    out: dict = {}
    if "add" in table:
        if not isinstance(table["add"], list):
            raise ConfigError("blocking.add must be a list")
        added = []
        for entry in table["add"]:
            if not isinstance(entry, dict):
                raise ConfigError("blocking.add entries must be tables")
            for key in ("name", "help", "category"):
                if not isinstance(entry.get(key), str):
                    raise ConfigError(f"Blocking entry missing required field '{key}'")
            if entry["category"] not in CATEGORIES:
                raise ConfigError(f"Unknown category '{entry['category']}'. Valid: {', '.join(CATEGORIES)}")
            added.append((entry["name"], entry["help"], entry["category"]))
        out["added"] = tuple(added)
    if "remove" in table:
        out["removed"] = _texts(table["remove"], "blocking.remove")
    if "blocking_modules" in table:
        out["blocking_modules"] = _texts(table["blocking_modules"], "blocking.blocking_modules")
    return out


def _wrappers(table: dict) -> tuple:
    out = []
    for name, value in table.items():
        if not isinstance(value, dict):
            raise ConfigError(f"Executor wrapper '{name}' must be a table")
        if "callable_param" not in value:
            raise ConfigError(f"Executor wrapper '{name}' missing required field 'callable_param'")
        param = value["callable_param"]
        if isinstance(param, int) and not isinstance(param, bool) and param >= 0:
            out.append((name, param, None))
        elif isinstance(param, str):
            out.append((name, None, param))
        else:
            raise ConfigError(f"Executor wrapper '{name}' callable_param must be an integer index or keyword name")
    return tuple(out)


def parse(text: str, root: str, tool: str = TOOL) -> Config:
    try:
        whole = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(str(error)) from error
    base = Path(root)
    config = Config(root=root, cache_dir=str(base / f".{tool}_cache"))
    table = (whole.get("tool") or {}).get(tool) if isinstance(whole.get("tool"), dict) else None
    if not isinstance(table, dict):
        return config
    found: dict = {}
    if "src_roots" in table:
        found["src_roots"] = tuple(str(base / x) for x in _texts(table["src_roots"], "src_roots"))
    if "exclude" in table:
        found["exclude"] = _texts(table["exclude"], "exclude")
    if "stub_paths" in table:
        found["stub_paths"] = tuple(str(base / x) for x in _texts(table["stub_paths"], "stub_paths"))
    if "python_version" in table:
        found["python_version"] = check_version(_text(table["python_version"], "python_version"))
    if "intervention_strategy" in table:
        found["intervention_strategy"] = _choice(_text(table["intervention_strategy"], "intervention_strategy"), STRATEGIES, "Invalid strategy: must be 'first-party-deepest' or 'async-boundary'")
    if "severity" in table:
        found["severity"] = _choice(_text(table["severity"], "severity"), SEVERITIES, "Invalid severity: must be 'error' or 'warning'")
    if "output_format" in table:
        found["output_format"] = _choice(_text(table["output_format"], "output_format"), FORMATS, "Invalid output_format: must be 'text', 'json', or 'sarif'")
    if "cache_dir" in table:
        found["cache_dir"] = str(base / _text(table["cache_dir"], "cache_dir"))
    if "cache_enabled" in table:
        if not isinstance(table["cache_enabled"], bool):
            raise ConfigError("cache_enabled must be a boolean")
        found["cache_enabled"] = table["cache_enabled"]
    if isinstance(table.get("blocking"), dict):
        found |= _blocking(table["blocking"])
    if isinstance(table.get("executor-wrappers"), dict):
        found["wrappers"] = _wrappers(table["executor-wrappers"])
    return replace(config, **found)


def _setuptools_roots(project: Path) -> tuple[str, ...]:
    try:
        value = tomllib.loads((project / "pyproject.toml").read_text())
    except (OSError, tomllib.TOMLDecodeError):
        return ()
    for key in ("tool", "setuptools", "packages", "find", "where"):
        value = value.get(key) if isinstance(value, dict) else None
    return tuple(str(project / x) for x in _texts(value, "where")) if value is not None else ()


def load(project: str, config_path: str | None = None, **overrides) -> Config:
    """The configuration of a project folder: given file, else its pyproject.toml, else defaults; then overrides."""
    base = Path(project)
    if not base.exists():
        raise ConfigError(f"Source root '{project}' does not exist")
    path = Path(config_path) if config_path else base / "pyproject.toml"
    if path.exists():
        config = parse(path.read_text(), str(path.resolve().parent if config_path else base))
    elif config_path:
        raise ConfigError(f"{config_path} does not exist")
    else:
        config = parse("", str(base))
    if overrides.get("python_version"):
        check_version(overrides["python_version"])
    config = replace(config, **{k: v for k, v in overrides.items() if v is not None})
    roots = config.src_roots or _setuptools_roots(base) or ((str(base / "src"),) if (base / "src").is_dir() else (str(base),))
    for r in (*roots, *config.stub_paths):
        if not Path(r).exists():
            raise ConfigError(f"Source root '{r}' does not exist")
    return replace(config, roots=roots)
