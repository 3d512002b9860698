"""Settings with dotted access and overlays; arrays and scalars of an overlay replace."""

from __future__ import annotations

import copy
import tomllib

from ..sources.files import DEFAULT_EXCLUDES

#: Settings and their defaults (fixed values).
DEFAULTS = {
    "recall": {"budget": 2000, "expand_refs": True, "max_ref_expansions": 3, "min_results": 2, "memory_hits": 10, "code_hits": 10, "seed_hits": 5},
    "index": {"max_lines": 200},
    "code": {"max_lines": 100, "min_lines": 3, "overlap": 10, "exclude_patterns": list(DEFAULT_EXCLUDES)},
    "consolidation": {"decay_days": 90, "merge_threshold": 0.85, "protected_access_count": 5, "max_memory_tokens": 120, "auto": True, "auto_stale_days": 7},
    "inbox": {"capacity": 10},
    "embedding": {"provider": "hash"},
}


class Config:
    def __init__(self, *overlays: dict):
        self.values = copy.deepcopy(DEFAULTS)
        for o in overlays:
            self.values = _merge(self.values, o)

    @classmethod
    def read(cls, *paths: str) -> Config:
        files = []
        for p in paths:
            with open(p, "rb") as f:
                files.append(tomllib.load(f))
        return cls(*files)

    def get(self, path: str):
        at = self.values
        for key in path.split("."):
            if not isinstance(at, dict) or key not in at:
                raise KeyError(path)
            at = at[key]
        return at

    def set(self, path: str, text: str) -> None:
        """Sets a value from text, keeping the type it has."""
        old = self.get(path)
        *above, last = path.split(".")
        at = self.values
        for key in above:
            at = at[key]
        if isinstance(old, bool):
            if text not in ("true", "false"):
                raise ValueError("true or false")
            at[last] = text == "true"
        else:
            at[last] = type(old)(text) if not isinstance(old, list) else [x.strip() for x in text.split(",")]


def _merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
