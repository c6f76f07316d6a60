"""Layered settings, small state, context files and guidance: plain values on the driver."""

from __future__ import annotations

import copy
import fnmatch
import json
import os
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas blanked, so that places in the text stay."""
    out, i, quoted = list(text), 0, False
    while i < len(text):
        if quoted:
            if text[i] == "\\":
                i += 1
            elif text[i] == '"':
                quoted = False
        elif text[i] == '"':
            quoted = True
        elif text.startswith(("//", "/*"), i):
            end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i + 2)
            end = len(text) if end < 0 else end + (0 if text[i + 1] == "/" else 2)
            out[i:end] = [c if c == "\n" else " " for c in out[i:end]]
            i = end
            continue
        i += 1
    clean = "".join(out)
    quoted, last = False, None
    for i, c in enumerate(clean):
        if quoted:
            quoted = c != '"' or clean[i - 1] == "\\" and clean[i - 2] != "\\"
        elif c == '"':
            quoted, last = True, None
        elif c == ",":
            last = i
        elif c in "]}":
            if last is not None:
                out[last] = " "
            last = None
        elif not c.isspace():
            last = None
    return "".join(out)


def parse_jsonc(text: str, name: str = "settings") -> object:
    """The value; a ValueError names line and column of what cannot be read."""
    try:
        return json.loads(without_comments(text))
    except json.JSONDecodeError as e:
        raise ValueError(f"{name}:{e.lineno}:{e.colno}: {e.msg}") from None


def merged(base: dict, over: dict) -> dict:
    """base with over's values; dicts merge, all else, lists too, is replaced; None leaves what is there."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif v is not None:
            out[k] = copy.deepcopy(v)
    return out


def load_config(defaults: dict, paths: Iterable[str] = (), flags: dict | None = None, valid: Callable[[dict], None] | None = None) -> dict:
    """defaults, then files that exist, in order, then flags; valid raises on what it refuses."""
    out = copy.deepcopy(defaults)
    for path in paths:
        if os.path.exists(path):
            value = parse_jsonc(Path(path).read_text(encoding="utf-8"), path)
            if not isinstance(value, dict):
                raise ValueError(f"{path}: not an object")
            out = merged(out, value)
    out = merged(out, flags or {})
    if valid:
        valid(out)
    return out


class State:
    """Small JSON values by name in a folder; a missing or broken one is None."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def read(self, name: str) -> object:
        try:
            return json.loads((self.folder / f"{name}.json").read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None

    def write(self, name: str, value: object) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=self.folder, delete=False, encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(f.name, self.folder / f"{name}.json")

    def remove(self, name: str) -> None:
        (self.folder / f"{name}.json").unlink(missing_ok=True)


def context_files(folder: str, names: Iterable[str]) -> list[tuple[str, str]]:
    """(path, text) of the named files in a folder and those above it, the topmost folder first."""
    at, names, out = Path(folder).resolve(), list(names), []
    for place in [*reversed(at.parents), at]:
        for name in names:
            path = place / name
            if path.is_file():
                out.append((str(path), path.read_text(encoding="utf-8", errors="replace")))
    return out


def guidance(model: str, provider: str, by_model: dict[str, str], by_provider: dict[str, str], default: str | None, present: Iterable[tuple[str, str]] = ()) -> str | None:
    """The guidance file's text for a model: by the first pattern that fits its name, by provider, or the default; none
    if a context file (name, text) holds the same text already."""
    text = next((t for pattern, t in by_model.items() if fnmatch.fnmatchcase(model.lower(), pattern.lower())), None) or by_provider.get(provider) or default
    return None if text is None or any(t.strip() == text.strip() for _, t in present) else text


class Sources:
    """Named sources of a turn's context, in order of priority; one of the same name replaces the former."""

    def __init__(self):
        self.by_name: dict[str, tuple[int, Callable]] = {}

    def register(self, name: str, priority: int, source: Callable) -> None:
        self.by_name[name] = (priority, source)

    def unregister(self, name: str) -> bool:
        return self.by_name.pop(name, None) is not None

    def clear(self) -> None:
        self.by_name.clear()

    def __iter__(self):
        return iter(name for name, _ in sorted(self.by_name.items(), key=lambda x: x[1][0]))


class Memo:
    """Values by key for a session."""

    def __init__(self):
        self.held: dict = {}

    def get(self, key, make: Callable):
        if key not in self.held:
            self.held[key] = make()
        return self.held[key]

    def has(self, key) -> bool:
        return key in self.held

    def clear(self) -> None:
        self.held.clear()
