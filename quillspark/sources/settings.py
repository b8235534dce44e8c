"""Where things lie, and settings from a file of KEY=value lines."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """The folders of a store, by what they hold; any path that Spark can read may be the root."""

    root: str

    def _at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    books = property(lambda self: self._at("books"))
    uploads = property(lambda self: self._at("uploads"))
    graphs = property(lambda self: self._at("graphs"))
    logs = property(lambda self: self._at("logs"))
    indexes = property(lambda self: self._at("indexes"))
    archive = property(lambda self: self._at("archive"))


def parse_settings(text: str) -> dict[str, str]:
    """KEY=value lines; blank lines, lines with # in front and lines without = don't count, quotes around a value go."""
    out = {}
    for line in map(str.strip, text.lstrip("\ufeff").splitlines()):
        if line and not line.startswith("#") and "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if key:
                out[key] = value.strip('"').strip("'")
    return out


def load_settings(path: str, into: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    """Sets what isn't set (or is blank) so far from a driver-side file; a file that isn't there sets nothing. Returns what was set."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        new = {k: v for k, v in parse_settings(f.read()).items() if not into.get(k, "").strip()}
    into.update(new)
    return new
