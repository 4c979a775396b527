"""JSON-RPC tools over a tree: merge, map, read and grep, with masking always on."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable

_PATH = {"type": "string"}
TOOLS = {
    "merge": {"root": _PATH, "out": _PATH},
    "map": {"root": _PATH, "tokens": {"type": "integer"}},
    "read": {"path": _PATH, "offset": {"type": "integer"}, "limit": {"type": "integer"}},
    "grep": {"path": _PATH, "pattern": {"type": "string"}},
}
MOST_LINES, MOST_BYTES, MOST_HITS, WIDTH = 1000, 200 * 1024, 100, 400


def _output(path: str) -> str:
    if "_merged." not in os.path.basename(path) or not os.path.isfile(path):
        raise ValueError("only results of a merge can be read")
    return path


def read_lines(path: str, offset: int = 1, limit: int = 200) -> str:
    """Numbered lines of a result, within the limits."""
    out, held = [], 0
    with open(_output(path), errors="replace") as f:
        for i, line in enumerate(f, 1):
            if i >= offset:
                held += len(line.encode())
                if len(out) >= min(limit, MOST_LINES) or held > MOST_BYTES:
                    break
                out.append(f"{i}: {line.rstrip(chr(10))}")
    return "\n".join(out)


def grep_lines(path: str, pattern: str) -> str:
    """The first lines of a result that match."""
    rule, out = re.compile(pattern), []
    with open(_output(path), errors="replace") as f:
        for i, line in enumerate(f, 1):
            if rule.search(line):
                out.append(f"{i}: {line.rstrip(chr(10))[:WIDTH]}")
                if len(out) == MOST_HITS:
                    break
    return "\n".join(out)


def tools(spark) -> dict[str, Callable[..., str]]:
    """The tools over a session."""
    from dataclasses import asdict

    from corpusmill.plans.merge import merge, repo_map

    return {
        "merge": lambda root, out: json.dumps({k: v for k, v in asdict(merge(spark, root, out)).items() if k in ("files", "merged", "tokens", "secrets", "parts")}),
        "map": lambda root, tokens=1024: repo_map(spark, root, tokens),
        "read": read_lines,
        "grep": grep_lines,
    }


def _error(id: object, code: int, message: str) -> dict:
    return {"id": id, "error": dict(code=code, message=message), "jsonrpc": "2.0"}


def handle(line: str, calls: dict[str, Callable[..., str]]) -> dict | None:
    """The answer to one request; none to a notification.  A tool's failure is a result, not an error of the protocol."""
    try:
        r = json.loads(line)
    except ValueError:
        return _error(None, -32700, "the request isn't JSON")
    if "id" not in r:
        return None
    answer: dict = {"jsonrpc": "2.0", "id": r["id"]}
    method, params = r.get("method"), r.get("params") or {}
    if method == "initialize":
        about = {"version": "1", "name": "corpusmill"}
        return answer | {"result": {"serverInfo": about, "capabilities": {"tools": {}}, "protocolVersion": params.get("protocolVersion", "2024-11-05")}}
    if method == "ping":
        return answer | {"result": {}}
    if method == "tools/list":
        listed = [{"name": k, "description": k, "inputSchema": {"properties": v, "type": "object"}} for k, v in TOOLS.items()]
        return answer | {"result": {"tools": listed}}
    if method != "tools/call":
        return _error(r["id"], -32601, f"there is no method {method}")
    try:
        text, bad = calls[params["name"]](**(params.get("arguments") or {})), False
    except Exception as e:  # whatever a tool raises is what its caller is told
        text, bad = f"{type(e).__name__}: {e}", True
    said = {"text": text, "type": "text"}
    return answer | {"result": {"isError": bad, "content": [said]}}


def serve(spark) -> None:
    """Answers requests on the standard input until it ends."""
    calls = tools(spark)
    for line in sys.stdin:
        if line.strip() and (answer := handle(line, calls)) is not None:
            print(json.dumps(answer), flush=True)
