"""A workspace: layered configuration, and paths that writing can't leave."""

from __future__ import annotations

import json
import os
import platform
import re
import shutil
import sys
from pathlib import Path

from ..functions.constants import FREE_DISK_FLOOR
from ..functions.errors import ConfigError, need

# Names of the layers, and defaults.
LAYERS = ("engine_config.json", "engine_config.local.json")
ENV = "ENGINE_CONFIG"
DEFAULTS = {
    "source": {"export_dir": None, "export_zip": None},
    "paths": {"staging": "staging", "corpus": "corpus", "outputs": "outputs", "phase2": None, "phase3": None, "temp": ".work"},
    "expectations": {"expected_root": None, "min_free_bytes": 0},
    "runtime": {"python_requires": ">=3.12,<3.15"},
}


def _text(v) -> bool:
    return isinstance(v, str) and bool(v.strip())


def _text_or_null(v) -> bool:
    return v is None or isinstance(v, str)


def _count(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v >= 0


#: What each key's value has to be.
KINDS = {
    "source": dict.fromkeys(("export_dir", "export_zip"), _text_or_null),
    "paths": dict.fromkeys(("staging", "corpus", "outputs", "temp"), _text) | dict.fromkeys(("phase2", "phase3"), _text_or_null),
    "expectations": {"expected_root": _text_or_null, "min_free_bytes": _count},
    "runtime": {"python_requires": _text},
}


def checked(layer) -> dict:
    """A layer without unknown keys or wrong values."""
    need(isinstance(layer, dict), "CONFIG_NOT_OBJECT", ConfigError)
    for key, value in layer.items():
        if key == "$comment":
            continue
        if key == "profile":
            need(_text_or_null(value), "CONFIG_VALUE_INVALID", ConfigError)
            continue
        need(key in KINDS and (value is None or isinstance(value, dict)), "CONFIG_VALUE_INVALID", ConfigError)
        for name, x in (value or {}).items():
            need(name == "$comment" or name in KINDS[key] and KINDS[key][name](x), "CONFIG_VALUE_INVALID", ConfigError)
    return layer


def _layer(path: Path) -> dict:
    try:
        raw = path.read_text(encoding="utf-8")
    except (OSError, UnicodeError):
        raise ConfigError("CONFIG_LAYER_UNREADABLE") from None
    try:
        return checked(json.loads(raw))
    except ConfigError:
        raise
    except ValueError:
        raise ConfigError("CONFIG_JSON_INVALID") from None


def load_config(root: Path | str, config_path: str | None = None, env: dict | None = None) -> dict:
    """Defaults, then the committed, the local and the explicit layer; the explicit one has to exist."""
    found = [Path(root) / name for name in LAYERS]
    layers = [DEFAULTS, *(_layer(p) for p in found if p.exists())]
    explicit = config_path or (os.environ if env is None else env).get(ENV)
    if explicit:
        path = Path(explicit).expanduser()
        need(path.exists(), "CONFIG_FILE_MISSING", ConfigError)
        layers.append(_layer(path))
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            both = isinstance(value, dict) and isinstance(out.get(key), dict)
            out[key] = out[key] | value if both else dict(value) if isinstance(value, dict) else value
    return checked(out)


def python_satisfies(version, spec: str) -> bool:
    """Comma-joined comparisons, each of as many numbers as the longer side has."""
    need(_text(spec), "PYTHON_REQUIREMENTS_INVALID", ConfigError)
    have = [int(x) for x in version[:3]]
    conditions = [c for c in (x.strip() for x in spec.split(",")) if c]
    need(conditions, "PYTHON_REQUIREMENTS_INVALID", ConfigError)
    for c in conditions:
        m = re.fullmatch(r"([<>]=?|[=!]=)\s*(\d+(?:\.\d+)*)", c)
        need(m, "PYTHON_REQUIREMENTS_INVALID", ConfigError)
        want = [int(x) for x in m[2].split(".")]
        n = max(len(have), len(want))
        a, b = have + [0] * (n - len(have)), want + [0] * (n - len(want))
        sign = (a > b) - (a < b)
        if sign not in {"<": (-1,), "<=": (-1, 0), ">": (1,), ">=": (0, 1), "==": (0,), "!=": (-1, 1)}[m[1]]:
            return False
    return True


class Workspace:
    def __init__(self, root: Path | str, config: dict):
        self.root, self.config = Path(root).resolve(), config

    def _given(self, section: str, key: str) -> Path | None:
        value = self.config[section][key]
        return None if value is None else self.root / Path(value).expanduser()

    def source_dir(self) -> Path:
        path = self._given("source", "export_dir")
        need(path is not None, "SOURCE_DIR_NOT_CONFIGURED", ConfigError)
        need(path.exists(), "SOURCE_DIR_MISSING", ConfigError)
        need(path.is_dir(), "SOURCE_DIR_NOT_DIRECTORY", ConfigError)
        return path

    def source_zip(self) -> Path:
        path = self._given("source", "export_zip")
        need(path is not None, "SOURCE_ZIP_NOT_CONFIGURED", ConfigError)
        need(path.exists(), "SOURCE_ZIP_MISSING", ConfigError)
        need(path.is_file() and path.suffix.lower() == ".zip", "SOURCE_ZIP_NOT_FILE", ConfigError)
        return path

    def only_zip(self) -> Path:
        """The one archive in the source folder."""
        found = list(self.source_dir().iterdir())
        need(len(found) == 1 and found[0].is_file() and found[0].suffix.lower() == ".zip", "SOURCE_AMBIGUOUS", ConfigError)
        return found[0]

    def inside(self, path: Path | str, code: str = "WRITE_OUTSIDE_WORKSPACE") -> Path:
        """An absolute path within the root, links and dots resolved."""
        out = (self.root / path).resolve()
        need(out.is_relative_to(self.root), code, ConfigError)
        return out

    def folder(self, name: str) -> Path:
        value = self.config["paths"][name]
        if not value:
            return self.folder("outputs") / name
        return self.inside(value, "CONFIG_PATH_OUTSIDE_WORKSPACE")

    @property
    def expected_root(self) -> Path | None:
        path = self._given("expectations", "expected_root")
        return path.resolve() if path else None

    def preflight(self, version=None, free: int | None = None) -> None:
        """Python, the pinned root, no link on the way to it, and room on the disk."""
        need(python_satisfies(version or sys.version_info, self.config["runtime"]["python_requires"]), "PYTHON_VERSION_UNSUPPORTED", ConfigError)
        need(self.expected_root in (None, self.root), "WRONG_PROJECT", ConfigError)
        need(not any(p.is_symlink() for p in (self.root, *self.root.parents)), "REPARSE_ROOT", ConfigError)
        self.room(free)

    def room(self, free: int | None = None) -> None:
        """The disk has what is asked for, and 2 GiB at least."""
        least = max(FREE_DISK_FLOOR, self.config["expectations"]["min_free_bytes"])
        need((shutil.disk_usage(self.root).free if free is None else free) >= least, "DISK_BUDGET", ConfigError)

    def summary(self, include_paths: bool = False) -> dict:
        """What may be shown; paths only if asked for."""
        source, pin = self.config["source"], self.expected_root
        out = {
            "runtime": {"python_version": platform.python_version(), "python_implementation": platform.python_implementation(), "platform": sys.platform, "python_requires": self.config["runtime"]["python_requires"]},
            "expectations": {"expected_root_pinned": pin is not None, "min_free_bytes": self.config["expectations"]["min_free_bytes"]},
            "inputs": {"source_dir_configured": source["export_dir"] is not None, "source_zip_configured": source["export_zip"] is not None},
            "write_containment": "workspace_root",
        }
        if include_paths:
            names = {n: str(self.folder(n)) for n in ("outputs", "staging", "corpus", "temp")}
            out["paths"] = {"root": str(self.root)} | names | {"source_dir": str(self._given("source", "export_dir") or "") or None, "source_zip": str(self._given("source", "export_zip") or "") or None, "expected_root": str(pin) if pin else None}
        return out


def open_workspace(root: Path | str, config_path: str | None = None, env: dict | None = None) -> Workspace:
    base = Path(root)
    need(base.exists(), "WORKSPACE_MISSING", ConfigError)
    need(base.is_dir(), "WORKSPACE_NOT_DIRECTORY", ConfigError)
    return Workspace(base, load_config(base.resolve(), config_path, env))


def atomic_write(ws: Workspace, path: Path | str, data) -> Path:
    """Text, or JSON of anything else, under a temporary name first; ends with one line feed."""
    target = ws.inside(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    text = data if isinstance(data, str) else json.dumps(data, indent=2, ensure_ascii=True)
    partial = target.with_name(f"{target.name}.partial")
    with open(partial, "w", encoding="utf-8", newline="\n") as f:
        f.write(text.strip() + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(partial, target)
    return target


class RunLock:
    """One run at a time; a second one fails at once."""

    def __init__(self, path: Path):
        self.path = path

    def __enter__(self) -> "RunLock":
        import fcntl

        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.file = open(self.path, "a+b")
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            self.file.close()
            raise ConfigError("RUN_LOCKED") from None
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
