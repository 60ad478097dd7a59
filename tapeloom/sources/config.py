"""Small driver-side documents: settings, dataset indexes and their atomic writing."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from typing import Any


def deep_get(settings: Mapping[str, Any], path: str, default: Any = None) -> Any:
    """The value at a dotted path; the default only where a step is missing, so a null that is there stays null."""
    at: Any = settings
    for name in path.split("."):
        if not isinstance(at, Mapping) or name not in at:
            return default
        at = at[name]
    return at


def load_index(path: str) -> dict[str, Any]:
    """A JSON document that must be an object."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


def save_json(path: str, value: Any) -> None:
    """Writes readable JSON in one step: a reader sees the old or the new document, never a part."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, indent=2)
    os.replace(file.name, path)
