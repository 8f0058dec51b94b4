"""Settings from a file of KEY=VALUE lines; what the environment has already wins."""

from __future__ import annotations

import os
from pathlib import Path


def parse_line(line: str) -> tuple[str, str] | None:
    line = line.strip()
    if not line or line[0] == "#":
        return None
    name, equals, value = line.removeprefix("export ").partition("=")
    name, value = name.strip(), value.strip()
    if not equals or not name:
        return None
    quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
    return name, value[1:-1] if quoted else value


def load(path: str | Path = ".env", environ=os.environ) -> dict[str, str]:
    """What the file added; a missing file adds nothing."""
    path, added = Path(path), {}
    if path.exists():
        for pair in map(parse_line, path.read_text(encoding="utf-8").splitlines()):
            if pair and pair[0] not in environ:
                environ[pair[0]] = added[pair[0]] = pair[1]
    return added
