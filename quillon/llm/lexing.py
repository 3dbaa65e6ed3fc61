"""Languages of source files and the token patterns their lexers share."""

from __future__ import annotations

import re

#: Extensions of the languages that are lexed.
EXTENSIONS = {"py": "python", "rs": "rust", "ts": "typescript", "js": "javascript", "go": "go", "java": "java", "json": "json", "toml": "toml", "md": "markdown"}

_INTERPRETERS = {"python": "python", "node": "javascript", "deno": "typescript"}


def language_of(path: str | None, text: str | None = None) -> str | None:
    """The language a path stands for: by extension; without one, by the interpreter named in the first line."""
    name = (path or "").rsplit("/", 1)[-1]
    if "." in name.lstrip("."):
        return EXTENSIONS.get(name.rsplit(".", 1)[1].lower())
    first = re.match(r"#![^\n]*?(python|node|deno)[\d.]*\s*(?:\r?\n|$)", text or "")
    return _INTERPRETERS[first.group(1)] if first else None
