"""Absolute URLs: the engine's own resolver."""

from __future__ import annotations

import re

_CONTROL = re.compile("[\x00-\x1f]")
_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")
_PARTS = re.compile(r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", re.S)


def is_absolute(url: str) -> bool:
    """Longer than two signs and with a colon."""
    return len(url) > 2 and ":" in url


def _tidy(path: str) -> str:
    """Dots resolved and empty segments dropped; a final slash stays."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    last = path.rsplit("/", 1)[-1]
    return "/" + "/".join(out) + ("/" if out and last in ("", ".", "..") else "")


def resolve(base: str | None, rel: str | None) -> str:
    """``rel`` against ``base``; an absolute ``rel`` as it is; "" if neither is absolute."""
    base, rel = _CONTROL.sub("", base or ""), _CONTROL.sub("", rel or "")
    if is_absolute(rel) and _SCHEME.match(rel):
        return rel
    if not is_absolute(base):
        return rel if is_absolute(rel) else ""
    scheme, host, path, query, _ = _PARTS.match(base).groups()
    _, r_host, r_path, r_query, r_fragment = _PARTS.match(rel).groups() if not is_absolute(rel) else (None, None, rel, None, None)
    if r_host is not None:
        host, path, query = r_host, _tidy(r_path) if r_path else "", r_query
    elif r_path:
        path = _tidy(r_path if r_path.startswith("/") else path.rsplit("/", 1)[0] + "/" + r_path)
        query = r_query
    elif r_query is not None:
        query = r_query
    return f"{scheme}:{'' if host is None else '//' + host}{path}{query or ''}{r_fragment or ''}".replace(" ", "%20")
