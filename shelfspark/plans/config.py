"""Folders of the data and of the artifacts, from the environment or a .env file."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Folders:
    data: str
    artifacts: str
    models: str
    reports: str


#: NAME=value, NAME="value" or NAME='value', with or without export before and a comment behind.
_line = re.compile(r"""\s*(?:export\s+)?(?P<name>[A-Za-z_]\w*)\s*=\s*(?:'(?P<single>[^']*)'|"(?P<double>(?:[^"\\]|\\.)*)"|(?P<bare>[^#\n]*?))\s*(?:\#.*)?""")
_escapes = {"n": "\n", "t": "\t", "r": "\r"}


def read_env(path: str) -> dict[str, str]:
    """The values of a .env file; none if there is no such file. Single quotes keep all as it is, in double quotes a backslash
    escapes, and unquoted values end at a comment. Lines of another form are passed over."""
    if not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            m = _line.fullmatch(line.rstrip("\n"))
            if m is None:
                continue
            if m["double"] is not None:
                found[m["name"]] = re.sub(r"\\(.)", lambda e: _escapes.get(e[1], e[1]), m["double"])
            else:
                found[m["name"]] = m["single"] if m["single"] is not None else m["bare"]
    return found


def folders(base: str, environ: Mapping[str, str] | None = None) -> Folders:
    """DATA_DIR, ARTIFACTS_DIR, MODELS_DIR and REPORTS_DIR from the environment, or else from `base`/.env, or else data and
    artifacts below `base`, and models and reports below the artifacts. Writers make the folders."""
    env = read_env(f"{base}/.env") | dict(os.environ if environ is None else environ)
    artifacts = env.get("ARTIFACTS_DIR") or f"{base}/artifacts"
    return Folders(env.get("DATA_DIR") or f"{base}/data", artifacts, env.get("MODELS_DIR") or f"{artifacts}/models", env.get("REPORTS_DIR") or f"{artifacts}/reports")
