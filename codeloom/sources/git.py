"""Repositories behind git urls: shallow clone to a temporary folder, and its removal."""

from __future__ import annotations

import logging
import os
import re
import shutil
import subprocess
import uuid
from contextlib import contextmanager

from codeloom.errors import BadRequest, NotFound
from codeloom.functions.text import GIT_HOSTS

log = logging.getLogger(__name__)


def is_git_url(path: str) -> bool:
    low = path.strip().lower()
    return low.startswith(("http://", "https://")) or low.endswith(".git")


def normalize_git_url(url: str) -> str:
    own = url.strip()
    if own.lower().endswith(".git"):
        return own
    for host in GIT_HOSTS:
        if m := re.match(rf"https?://{re.escape(host)}/([^/]+/[^/]+)(?:/.*)?$", own, re.IGNORECASE):
            return f"https://{host}/{m[1]}.git"
    return own


def clone(url: str, below: str = "temp_repos") -> str:
    """Clone the last commit only; raises if git fails."""
    path = os.path.join(below, f"temp_cloned_{uuid.uuid4().hex}")
    os.makedirs(below, exist_ok=True)
    done = subprocess.run(["git", "clone", "--depth", "1", normalize_git_url(url), path], capture_output=True, text=True)
    if done.returncode:
        shutil.rmtree(path, ignore_errors=True)
        raise BadRequest(f"git clone failed: {done.stderr.strip()}")
    return path


def remove(path: str) -> None:
    try:
        shutil.rmtree(path)
    except OSError as e:
        log.warning("could not remove %s: %s", path, e)


@contextmanager
def local_repository(path: str, below: str | None = None):
    """A folder for a path or git url; a clone goes to the folder ``below``, which tasks see, and is removed afterwards."""
    path = path.strip().strip('"').strip()
    if not path:
        raise BadRequest("a repository path is required")
    if is_git_url(path):
        at = clone(path, below or "temp_repos")
        try:
            yield at
        finally:
            remove(at)
    elif os.path.isdir(path):
        yield path
    else:
        raise NotFound(f"no such folder: {path}")
