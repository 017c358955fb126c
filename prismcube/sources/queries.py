"""Reading query documents: files, folders, text."""

from __future__ import annotations

import json
import runpy
from pathlib import Path

from prismcube.errors import QueryError

#: What runs where no queries are named: revenue by day.
DEFAULT = [{"select": ["day", {"SUM": "bid_price"}], "from": "events", "where": [{"col": "type", "op": "eq", "val": "impression"}], "group_by": ["day"]}]


def from_text(text: str) -> list[dict]:
    """An array of queries, or one query."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise QueryError(f"not a JSON document: {e}") from e
    return found if isinstance(found, list) else [found]


def from_file(path: str) -> list[dict]:
    """A .json file (array or object) or a .py file that sets ``queries``."""
    p = Path(path)
    if not p.is_file():
        raise QueryError(f"{path} is no file")
    if p.suffix == ".py":
        found = runpy.run_path(str(p)).get("queries")
        if not isinstance(found, list):
            raise QueryError(f"{path} sets no list named queries")
        return found
    return from_text(p.read_text())


def from_folder(path: str) -> list[tuple[str, dict]]:
    """(stem, query) of every .json file, by name; an array gives numbered stems."""
    if not Path(path).is_dir():
        raise QueryError(f"{path} is no folder")
    out = []
    for p in sorted(Path(path).glob("*.json")):
        found = from_text(p.read_text())
        out += [(p.stem if len(found) == 1 else f"{p.stem}_{i}", q) for i, q in enumerate(found, 1)]
    return out


def load(file: str | None = None, folder: str | None = None) -> list[tuple[str, dict]]:
    """Named queries: of the file if given, else of the folder (an inputs.py in it first), else the default ones."""
    if file:
        return [(f"q{i}", q) for i, q in enumerate(from_file(file), 1)]
    if folder:
        inputs = Path(folder) / "inputs.py"
        if inputs.is_file():
            return [(f"q{i}", q) for i, q in enumerate(from_file(str(inputs)), 1)]
        if found := from_folder(folder):
            return found
        raise QueryError(f"{folder} has no queries")
    return [(f"q{i}", q) for i, q in enumerate(DEFAULT, 1)]
