"""Settings of a project: defaults, then its file, then what is given; and small files beside it."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Mapping

#: What holds where nothing else is said.
DEFAULTS = {"store": ".lodestone/index"}
FILES = ("lodestone.json", "lodestone.toml")
ZEROS = {"total_queries": 0, "total_tokens_saved": 0, "total_cost_avoided": {}}


def load(root: str, given: Mapping | None = None) -> dict:
    """The defaults, over them the project's file (JSON or TOML), over it what is given."""
    out = dict(DEFAULTS)
    for name in FILES:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, "rb") as f:
                out |= json.load(f) if name.endswith(".json") else tomllib.load(f)
            break
    return out | dict(given or {})


def project_root(given: str | None = None, env: Mapping[str, str] | None = None, cwd: str | None = None) -> str:
    """What is given, else the shell's folder, else where the command began, else the working folder."""
    env = os.environ if env is None else env
    return given or env.get("PWD") or env.get("INIT_CWD") or cwd or os.getcwd()


def read_totals(path: str) -> dict:
    """Totals of queries so far; zeros where the file is missing or cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return {k: data.get(k) or (dict(v) if isinstance(v, dict) else v) for k, v in ZEROS.items()}
    except (OSError, ValueError, AttributeError):
        return {k: dict(v) if isinstance(v, dict) else v for k, v in ZEROS.items()}


def write_totals(path: str, totals: Mapping) -> bool:
    """Writes totals if that can be done, and says whether it was."""
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dict(totals), f, indent=2)
        return True
    except OSError:
        return False


def worker(root: str, script: str = "lodestone.tools") -> dict:
    """How a worker starts this package's tools over a project."""
    return {"command": "python", "args": ["-m", script, root], "env": {}}
