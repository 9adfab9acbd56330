"""Which repository a folder belongs to: a preflight on the driver."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass


@dataclass(frozen=True)
class Resolution:
    """status: supported, allowlisted, linked_worktree, bare, no_repository or unknown."""

    status: str
    root: str | None = None


def _git(path: str, *args: str) -> tuple[int, str]:
    try:
        r = subprocess.run(["git", "-C", path, "rev-parse", *args], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return -1, ""
    return r.returncode, r.stdout.strip()


def resolve(path: str, allowed: tuple[str, ...] = ()) -> Resolution:
    """The root of the main work tree that holds path; folders without one are taken only where they are allowed."""
    code, bare = _git(path, "--is-bare-repository")
    if code < 0:
        return Resolution("unknown")
    if code:
        inside = [a for a in allowed if path == a or path.startswith(a.rstrip("/") + "/")]
        return Resolution("allowlisted", max(inside, key=len)) if inside else Resolution("no_repository")
    if bare == "true":
        return Resolution("bare")
    _, own = _git(path, "--path-format=absolute", "--git-dir")
    _, common = _git(path, "--path-format=absolute", "--git-common-dir")
    if own != common:
        return Resolution("linked_worktree")
    code, top = _git(path, "--show-toplevel")
    return Resolution("supported", top) if not code and top else Resolution("unknown")
