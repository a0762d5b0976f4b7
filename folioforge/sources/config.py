"""The configuration file: two levels of ``key: value`` with # comments."""

from __future__ import annotations

import re
from pathlib import Path

#: Fixed values.
DEFAULTS = {"seed": 12345, "contest": {"name": "Concurs biblic", "edition": 1}, "scoring": {"section_1": 2, "section_2": 4, "section_3": 2, "section_4": 5}}


#: A line: how far it is set in, its key, and what stands before a comment.
_ENTRY = re.compile(r"^(?P<depth>[ \t]*)(?P<key>[^\s:#][^:#\n]*?)[ \t]*:[ \t]*(?P<value>[^#\n]*?)[ \t]*(?:#.*)?$", re.M)


def _value(text: str) -> int | str:
    bare = text.strip("\"'")
    return int(bare) if bare.isdigit() else bare


def load_config(path: str | Path) -> dict:
    """DEFAULTS with the file's values over them; digits are numbers, a missing file changes nothing."""
    text = Path(path).read_text(encoding="utf-8") if Path(path).exists() else ""
    found: dict[tuple[str, ...], int | str | None] = {}
    parent: tuple[str, ...] = ()
    for entry in _ENTRY.finditer(text):
        name = (*(parent if entry["depth"] else ()), entry["key"])
        if not entry["depth"]:
            parent = () if entry["value"] else name
        found[name] = _value(entry["value"]) if entry["value"] or entry["depth"] else None
    flat = {(k, *inner): x for k, v in DEFAULTS.items() for inner, x in ({(i,): x for i, x in v.items()} if isinstance(v, dict) else {(): v}).items()}
    config: dict = {}
    for name, value in (flat | found).items():
        if len(name) > 1:
            config.setdefault(name[0], {})[name[1]] = value
        else:
            config[name[0]] = config.get(name[0], {}) if value is None else value
    return config
