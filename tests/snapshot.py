"""Locating a local copy of published results for the golden tests.

Set ``PROBITAS_SNAPSHOT`` to the root of such a copy; the tests find the files
they need by name pattern or header (nothing is assumed about the folder names)
and are skipped when the variable is unset or nothing matches.
"""

import glob
import os

ROOT = os.environ.get("PROBITAS_SNAPSHOT", "")


def answer_root(scenario: str | None = None) -> str | None:
    """Folder holding the answer files (``rm_answers_*.csv``) of all scenarios, or of one."""
    if not ROOT:
        return None
    for d, _, files in os.walk(ROOT):
        if any(f.startswith("rm_answers_") and f.endswith(".csv") for f in files):
            parts = d.split(os.sep)
            for i, p in enumerate(parts):
                if p.endswith("_scenario"):
                    base = os.sep.join(parts[:i])
                    return os.path.join(base, scenario) if scenario else base
    return None


def find(pattern: str) -> str | None:
    if not ROOT:
        return None
    hits = sorted(glob.glob(os.path.join(ROOT, "**", pattern), recursive=True))
    return hits[0] if hits else None


def find_by_header(prefix: str, contains: str) -> str | None:
    """First CSV whose header line starts with ``prefix`` and contains ``contains``."""
    if not ROOT:
        return None
    for path in sorted(glob.glob(os.path.join(ROOT, "**", "*.csv"), recursive=True)):
        with open(path, encoding="utf-8") as f:
            head = f.readline()
        if head.startswith(prefix) and contains in head:
            return path
    return None
