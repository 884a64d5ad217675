"""The tools over HTTP, behind a bearer token, with a store that is replaced while readers go on."""

from __future__ import annotations

import hmac
import json
import os
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from .chat import answer
from .engine import TOOLS, Engine
from .sources.formats import READERS

MOST_BYTES = 5 << 20

#: What each tool takes, as agents read it.
SPECS: dict[str, dict[str, str]] = {
    "search": {"query": "string", "k": "integer", "budget": "integer"}, "neighbors": {"name": "string", "k": "integer"}, "path": {"start": "string", "goal": "string", "k": "integer"},
    "why": {"name": "string", "k": "integer"}, "inspect": {"name": "string"}, "timeline": {"name": "string"}, "contradictions": {}, "conflicts": {}, "trace": {"decision": "string"},
    "decisions": {"query": "string", "k": "integer"}, "communities": {"k": "integer"}, "stats": {}, "gql": {"text": "string"}, "vision": {"query": "string", "k": "integer"},
}


class Current:
    """The engine that answers now; ``swap`` replaces it at once, and readers keep the one they took."""

    def __init__(self, engine: Engine):
        self._engine, self._lock = engine, threading.Lock()

    def get(self) -> Engine:
        with self._lock:
            return self._engine

    def swap(self, engine: Engine) -> None:
        with self._lock:
            self._engine = engine


def safe_name(name: str) -> str:
    """A file name without folders or odd signs."""
    base = re.sub(r"[^A-Za-z0-9._-]", "_", os.path.basename(name.replace("\\", "/"))).lstrip(".")
    if not base:
        raise ValueError("a file needs a name")
    return base[:120]


def acceptable(name: str, size: int) -> bool:
    """A known extension and not too large."""
    return os.path.splitext(name)[1].lower() in READERS and os.path.splitext(name)[1] != "" and 0 < size <= MOST_BYTES


def respond(engine: Engine, method: str, path: str, body: dict[str, Any]) -> tuple[int, Any]:
    """Status and answer of one request."""
    if path == "/api/tools":
        return 200, SPECS
    if path == "/api/chat" and method == "POST":
        return 200, answer(engine, str(body.get("question", "")), body.get("focus")).__dict__
    if path == "/api/call" and method == "POST":
        tool = body.get("tool")
        if tool not in TOOLS:
            return 404, {"error": f"unknown tool {tool!r}"}
        unknown = set(body.get("arguments", {})) - set(SPECS[tool])
        if unknown:
            return 400, {"error": f"unknown arguments: {', '.join(sorted(unknown))}"}
        try:
            rows = engine.call(tool, **body.get("arguments", {})).limit(200).collect()
        except (TypeError, ValueError) as e:
            return 400, {"error": str(e)}
        return 200, [r.asDict(recursive=True) for r in rows]
    return 404, {"error": "no such route"}


def server(current: Current, token: str, port: int = 0) -> ThreadingHTTPServer:
    """A server that answers requests with the token only."""
    if not token:
        raise ValueError("a server needs a token")

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            given = self.headers.get("Authorization", "")
            if not hmac.compare_digest(given, f"Bearer {token}"):
                status, out = 401, {"error": "unauthorized"}
            else:
                size = int(self.headers.get("Content-Length") or 0)
                try:
                    body = json.loads(self.rfile.read(min(size, MOST_BYTES)) or b"{}")
                    status, out = respond(current.get(), self.command, self.path, body)
                except ValueError as e:
                    status, out = 400, {"error": str(e)}
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
