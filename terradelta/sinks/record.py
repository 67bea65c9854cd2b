"""The record of a run: provenance, and a manifest of its files, computed last."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import time
from contextlib import contextmanager
from dataclasses import asdict
from datetime import datetime, timezone

from ..config import Config


@contextmanager
def logged(path: str, began: float):
    """A function that adds a line with time and seconds since the start; an error that ends the run is its last line."""

    def say(text: str) -> None:
        with open(path, "a", encoding="utf-8") as f:  # closed after each line, so a manifest holds whole lines
            f.write(f"{datetime.now(timezone.utc).isoformat(timespec='milliseconds')} +{time.time() - began:.1f} s  {text}\n")

    open(path, "w").close()
    try:
        yield say
    except Exception as e:
        say(f"{type(e).__name__}: {e}")
        raise


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def pair_id(before_sha: str, after_sha: str) -> str:
    return hashlib.sha256((before_sha + after_sha).encode()).hexdigest()[:12]


def manifest(folder: str) -> dict[str, dict]:
    """Size and hash of every file below a folder, by name; the provenance itself is left out."""
    found = sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)
    return {n: {"size": os.path.getsize(p), "sha256": file_sha256(p)} for n in found if n != "provenance.json" for p in [os.path.join(folder, n)]}


def config_snapshot(config: Config, path: str) -> str:
    """Writes the settings and returns their hash."""
    text = json.dumps(asdict(config), indent=2, sort_keys=True)
    with open(path, "w") as f:
        f.write(text + "\n")
    return hashlib.sha256(text.encode()).hexdigest()


def software_versions() -> dict[str, str]:
    import numpy
    import pandas
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__, "pandas": pandas.__version__, "platform": platform.platform()}


def write_json(path: str, value) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, default=str)
        f.write("\n")


def write_provenance(path: str, record: dict) -> None:
    write_json(path, {**record, "generated_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "software": software_versions()})
