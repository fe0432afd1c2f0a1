"""Settings from the environment and the nearest .env file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Remote:
    """Who calls remote services, and what they are asked by default. Fields are named like their variables."""

    ncbi_email: str | None = None
    ncbi_tool: str | None = None
    ncbi_api_key: str | None = None
    blast_program: str | None = None
    blast_db: str | None = None

    def missing(self) -> Iterator[str]:
        return (f.name.upper() for f in fields(self) if not getattr(self, f.name))


def find(start: str | Path | None = None) -> Path | None:
    """The closest .env in a folder or those above it."""
    here = Path(start or Path.cwd()).resolve()
    return next((p / ".env" for p in (here, *here.parents) if (p / ".env").is_file()), None)


def parse(text: str) -> dict[str, str]:
    """KEY=value lines; blank ones, comments and lines without = are skipped, one pair of quotes is stripped."""
    out = {}
    for line in map(str.strip, text.splitlines()):
        key, eq, value = line.partition("=")
        if eq and not line.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[key.strip()] = value[1:-1] if quoted else value
    return out


def load(start: str | Path | None = None) -> Path | None:
    """Puts a .env file's values into the environment where it has none."""
    path = find(start)
    for key, value in parse(path.read_text("utf-8")).items() if path else ():
        os.environ.setdefault(key, value)
    return path


def remote(start: str | Path | None = None) -> Remote:
    load(start)
    return Remote(**{f.name: os.environ.get(f.name.upper()) for f in fields(Remote)})
