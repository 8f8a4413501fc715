"""Settings of the engine, with defaults; changes are merged in, and a record of them goes with each run."""

from __future__ import annotations

from collections.abc import Callable
from copy import deepcopy
from typing import Any

#: The defaults of all settings.
DEFAULTS: dict[str, Any] = {
    "version": 1,
    "llm": {"temperature": 0.5, "max_tokens": 768, "top_p": 0.9, "repeat_penalty": 1.15, "context_window_size": 2048},
    "embeddings": {"max_length": 256},
    "chunking": {"enabled": True, "chunk_size": 512, "chunk_overlap": 128, "min_chunk_size": 50},
    "search": {"num_results": 5, "retrieval_k": 60, "vector_weight": 0.6, "similarity_threshold": 0.7},
    "clustering": {"n_neighbors": 15, "min_dist": 0.0, "dimensions": 15, "min_cluster_size": 5, "min_samples": 5},
    "hyde": {"temperature": 0.2, "max_tokens": 256},
}


def merged(base: dict, changes: dict) -> dict:
    """base with changes, dict within dict; lists and values are replaced."""
    out = deepcopy(base)
    for key, value in changes.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else deepcopy(value)
    return out


class Config:
    """Settings by dotted path; observers hear of each change."""

    def __init__(self, changes: dict | None = None):
        self.values = merged(DEFAULTS, migrated(changes or {}))
        self.observers: list[Callable[[str, Any], None]] = []

    def get(self, path: str, default: Any = None) -> Any:
        at: Any = self.values
        for key in path.split("."):
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at

    def set(self, path: str, value: Any) -> None:
        *above, last = path.split(".")
        at = self.values
        for key in above:
            at = at.setdefault(key, {})
        at[last] = value
        for heard in self.observers:
            heard(path, value)


def migrated(saved: dict) -> dict:
    """Settings of any version as of this one; keys that no version knows are kept."""
    return {**saved, "version": DEFAULTS["version"]}
