"""Settings in four layers: defaults, global file, project file, explicit file."""

from __future__ import annotations

import os
import tomllib

DEFAULTS = {
    "root": ".",
    "sandbox_indexing": True,
    "indexer": {"max_file_size": 10 << 20, "respect_gitignore": True},
    "embedding": {"provider": "local", "dimensions": 1024},
    "query": {"default_max_results": 20, "fff_weight": 0.3, "vector_weight": 0.5, "graph_weight": 0.2, "bm25_weight": 0.35, "max_context_tokens": 8000},
    "wiki": {"stale_days": 180},
}


def merge(base: dict, over: dict) -> dict:
    """over wins; tables are merged key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(*paths: str | None) -> dict:
    """The defaults under the given files, the last one strongest; missing files are skipped. [project] root and [security] sandbox_indexing are read as well."""
    out = DEFAULTS
    for p in paths:
        if p and os.path.exists(p):
            with open(p, "rb") as f:
                read = tomllib.load(f)
            flat = {**read}
            if "root" in read.get("project", {}):
                flat.setdefault("root", read["project"]["root"])
            if "sandbox_indexing" in read.get("security", {}):
                flat.setdefault("sandbox_indexing", read["security"]["sandbox_indexing"])
            out = merge(out, flat)
    return out
