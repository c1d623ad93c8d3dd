"""What a run did, and whether a later one did the same."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Mapping

LARGE = 1 << 30  # bytes above which a file's metadata stands for its content


def file_digest(path: str) -> str:
    """SHA-256 of a file, or of its name, size and time where it is large."""
    h = hashlib.sha256()
    stat = os.stat(path)
    if stat.st_size > LARGE:
        h.update(f"{os.path.basename(path)}|{stat.st_size}|{int(stat.st_mtime)}".encode())
        return h.hexdigest()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


class Recorder:
    """Collects the stages of a run and writes one JSON document."""

    def __init__(self, name: str, config: Mapping | None = None):
        self.document = {"name": name, "started": time.time(), "config": dict(config or {}), "inputs": {}, "stages": []}

    def input(self, path: str) -> None:
        self.document["inputs"][path] = file_digest(path)

    def stage(self, name: str, **figures) -> None:
        self.document["stages"].append({"stage": name, **figures})

    def finalize(self, path: str) -> dict:
        self.document["finished"] = time.time()
        body = json.dumps({k: self.document[k] for k in ("name", "config", "inputs", "stages")}, sort_keys=True)
        self.document["fingerprint"] = hashlib.sha256(body.encode()).hexdigest()
        with open(path, "w") as f:
            json.dump(self.document, f, indent=1)
        return self.document


def verify_inputs(document: Mapping) -> dict[str, str]:
    """Inputs that are missing or differ from the manifest."""
    out = {}
    for path, digest in document["inputs"].items():
        if not os.path.exists(path):
            out[path] = "missing"
        elif file_digest(path) != digest:
            out[path] = "changed"
    return out


def replay(document: Mapping, stages: Mapping[str, Callable[[], Mapping]], tolerance: Mapping[str, float] | None = None) -> list[dict]:
    """Run the recorded stages again and compare their figures; stops at the first that differs.

    A numeric figure may differ by its tolerance (a fraction); others must be equal.
    """
    out = []
    for recorded in document["stages"]:
        name = recorded["stage"]
        if name not in stages:
            out.append({"stage": name, "ok": False, "why": "no such stage"})
            break
        now = stages[name]()
        bad = []
        for k, was in recorded.items():
            if k == "stage":
                continue
            got = now.get(k)
            slack = (tolerance or {}).get(k, 0.0)
            same = abs(got - was) <= slack * max(1.0, abs(was)) if isinstance(was, (int, float)) and isinstance(got, (int, float)) else got == was
            if not same:
                bad.append(f"{k}: {was} then, {got} now")
        out.append({"stage": name, "ok": not bad, "why": "; ".join(bad)})
        if bad:
            break
    return out
