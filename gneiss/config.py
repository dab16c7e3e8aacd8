"""Settings as nested sections: defaults, then a file, then what the caller gives."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, Any] = {
    "source": {"mode": "auto"},
    "chunk": {"target": 512, "overlap": 48, "min_lines": 5, "functions_only": True, "context_tokens": 120},
    "embedding": {"version": "hash-128", "dim": 128, "batch": 32, "attempts": 3, "wait": 0.5},
    "vectors": {"write": "primary_only", "read": "primary"},
    "retrieval": {"mode": "hybrid", "blend": "linear", "top_k": 10},
    "graph": {"edge_type": "calls", "hops": 1},
    "community": {"resolutions": [0.35], "semantic_top_k": 20, "edge_least": 0.05},
}


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """``base`` with the values of ``over``; sections merge key by key, everything else is replaced.  Neither is changed."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else copy.deepcopy(value)
    return out


def load(path: str | None = None, given: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults under the JSON file at ``path`` under ``given``."""
    settings = dict(DEFAULTS)
    if path:
        with open(path, encoding="utf-8") as file:
            settings = merged(settings, json.load(file))
    return merged(settings, given or {})


def fingerprint(settings: Mapping[str, Any]) -> str:
    """Digest that does not depend on the order of keys."""
    return hashlib.sha1(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def overridden(rules: Mapping[str, Any], slug: str, repo: str, sha: str) -> dict[str, Any]:
    """The defaults of ``rules`` under what it has for the slug, for repo@sha and for repo|sha, the later before the earlier."""
    out = dict(rules.get("defaults", {}))
    for key in (slug, f"{repo}@{sha}", f"{repo}|{sha}"):
        out = merged(out, rules.get(key, {}))
    return out
