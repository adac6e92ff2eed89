"""Canonical JSON of manifests and commits, and their decoding."""

from __future__ import annotations

import hashlib
import json


def canonical(value) -> bytes:
    """Sorted keys, no spaces, UTF-8: equal values have equal bytes, and so equal hashes."""
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def manifest_bytes(tensors: dict, metadata: dict | None = None, header: str | None = None) -> bytes:
    """``header``: the hash of the file's own header."""
    return canonical({"tensors": tensors, "metadata": metadata or {}} | ({"header": header} if header else {}))


def read_manifest(data: bytes) -> dict:
    return {"tensors": {}, "metadata": {}, "header": None} | json.loads(data)


def commit_bytes(manifest_hash: str, parents: list[str], message: str, author: str, at: float) -> bytes:
    return canonical({"manifest": manifest_hash, "parents": parents, "message": message, "author": author, "at": at})


def read_commit(data: bytes) -> dict:
    found = json.loads(data)
    if not isinstance(found, dict) or "manifest" not in found:
        raise ValueError("a commit names its manifest")
    return {"parents": [], "message": "", "author": "", "at": 0.0} | found
