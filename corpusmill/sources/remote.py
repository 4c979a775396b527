"""Sources outside of the tree: repositories to clone, git context, and settings files."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
import time
import tomllib
from dataclasses import replace

from corpusmill.operators.classify import ScanOptions

MOST_DIFF = 512 * 1024


def with_token(url: str, token: str) -> str:
    """The address with an access token."""
    return url.replace("https://", f"https://x-access-token:{token}@", 1) if token and url.startswith("https://") else url


def clone_url(given: str) -> str | None:
    """``functions.text.clone_url`` for one address."""
    s = given.strip()
    if re.search(r"\s", s):
        return None
    if m := re.match(r"https?://([^/\s]*\.[^/\s]*/[^\s]+?)/*$", s):
        path = re.sub("/(tree|blob)/.*$", "", m[1]).rstrip("/")
        if re.match("[^/]+/[^/]*/", m[1]):
            return f"https://{path}" + ("" if path.endswith(".git") else ".git")
    if re.match("https?://", s):
        return None
    if re.match("git@[^:]*:.+", s):
        return s
    return f"https://github.com/{s}.git" if re.fullmatch(r"[0-9A-Za-z_-][0-9A-Za-z._-]*/[0-9A-Za-z._-]+", s) else None


def resolve(source: str, token: str = "") -> tuple[str, tempfile.TemporaryDirectory | None]:
    """(folder, clone): a folder that is there as it is, else a clone of the repository that the source names; the token comes from the caller's environment only."""
    if os.path.isdir(source):
        return source, None
    url = clone_url(source)
    if url is None:
        raise ValueError(f"{source} is neither a folder nor a repository")
    held = clone(url, token)
    return held.name, held


def output_name(root: str, ext: str, stamp: str | None = None) -> str:
    """The name of an output where none is given: the folder's, the time, and what marks our own outputs."""
    return f"{os.path.basename(os.path.realpath(root))}_{stamp or time.strftime('%Y%m%d_%H%M%S')}_merged.{ext}"


def clone(url: str, token: str = "") -> tempfile.TemporaryDirectory:
    """A shallow clone in a folder that goes when it is closed; the token is kept out of errors."""
    to = tempfile.TemporaryDirectory(prefix="corpusmill-clone-")
    run = subprocess.run(["git", "clone", "--depth", "1", "--single-branch", "--no-tags", with_token(url, token), to.name], capture_output=True, text=True, env={**os.environ, "GIT_TERMINAL_PROMPT": "0"})
    if run.returncode:
        to.cleanup()
        raise RuntimeError(run.stderr.replace(token, "***") if token else run.stderr)
    return to


def _git(root: str, *args: str) -> str | None:
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace")
    return run.stdout if run.returncode == 0 else None


def git_diff(root: str) -> tuple[str | None, str | None]:
    """(diff, note): the uncommitted changes, cut at MOST_DIFF bytes; a note if there are none or it is no repository."""
    out = _git(root, "diff", "HEAD")
    if out is None:
        return None, "not a git repository"
    if not out:
        return None, "no uncommitted changes"
    data = out.encode()
    return (out, None) if len(data) <= MOST_DIFF else (data[:MOST_DIFF].decode("utf-8", "ignore") + "\n[cut]\n", None)


def git_log(root: str, n: int) -> tuple[str | None, str | None]:
    """(log, note): the last commits, one a line."""
    out = _git(root, "log", "--date=short", "--format=%h %ad %an — %s", f"-{n}")
    return (out, None) if out is not None else (None, "not a git repository")


def settings(root: str, options: ScanOptions = ScanOptions()) -> tuple[ScanOptions, str | None]:
    """(options, warning): the options with those of ``corpusmill.toml`` added; a missing or malformed file changes nothing."""
    path = os.path.join(root, "corpusmill.toml")
    if not os.path.isfile(path):
        return options, None
    try:
        with open(path, "rb") as f:
            t = tomllib.load(f)
        e, s, g = t.get("extensions", {}), t.get("scanning", {}), t.get("filter", {})
        return replace(
            options,
            text_extensions=(*options.text_extensions, *e.get("include", ())), skip_extensions=(*options.skip_extensions, *e.get("exclude", ())), binary_extensions=(*options.binary_extensions, *e.get("binary", ())),
            include_venv=options.include_venv or s.get("include_venv", False), include_hidden=options.include_hidden or s.get("include_hidden", False), content_sniff=options.content_sniff and s.get("content_sniff", True),
            max_file_size=int(s["max_file_size_mb"] * 1024 * 1024) if "max_file_size_mb" in s else options.max_file_size,
            include_globs=(*options.include_globs, *g.get("include", ())), exclude_globs=(*options.exclude_globs, *g.get("exclude", ())),
        ), None
    except (tomllib.TOMLDecodeError, TypeError, ValueError, AttributeError) as err:
        return options, f"{path}: {err}"
