"""Searches and status as tools of a language model: JSON-RPC 2.0, one message in, at most one out."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from . import render
from .engine import Engine
from .plans.search import PAGE_DEFAULTS, SearchRefused

# Protocol revisions, newest first, error codes, and the names and defaults of the tools' arguments.
REVISIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602
SORTS = ["name", "-name", "path", "-path", "newest", "oldest", "newest_created", "oldest_created"]
BATCH = 32
#: The client whose searches narrow while a model refines its query.
CLIENT = -1


class RpcError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def catalogue() -> list[dict]:
    """The tools with the schemas of their arguments."""
    limit, most = PAGE_DEFAULTS["tool"]
    whole = lambda least, default, **more: {"type": "integer", "minimum": least, "default": default, **more}
    search = {
        "query": {"type": "string", "minLength": 1, "description": "words that the name holds; | or, ! not, \"phrase\", * and ?, ext:a;b path:x parent:C:\\dir folder: file: wfn:name regex:re case:Word"},
        "sort": {"type": "string", "enum": SORTS, "default": "name"}, "limit": whole(1, limit, maximum=most), "offset": whole(0, 0), "details": {"type": "boolean", "default": False},
    }
    shape = lambda properties, *needed: {"type": "object", "properties": properties, "required": list(needed), "additionalProperties": False}
    return [{"name": "search_files", "description": "Files and folders by name, as full paths; a folder's name ends with a backslash.", "inputSchema": shape(search, "query")},
            {"name": "index_status", "description": "Rows of each volume, and whether it is searched and followed.", "inputSchema": shape({})}]


def _search(engine: Engine, arguments: dict) -> str:
    known = set(catalogue()[0]["inputSchema"]["properties"])
    if strange := sorted(set(arguments) - known):
        raise ValueError(f"unknown argument: {strange[0]}")
    if arguments.get("sort", "name") not in SORTS:
        raise ValueError("sort must be one of: " + ", ".join(SORTS))
    if arguments.get("limit", 1) == 0 or not isinstance(arguments.get("details", False), bool):
        raise ValueError("limit must be 1 at least" if arguments.get("limit", 1) == 0 else "details must be true or false")
    a = render.validate_search(arguments)
    found = engine.search(a["query"], a["limit"], a["offset"], a["sort"], client_id=CLIENT)
    rows = [r.asDict() for r in found.page.orderBy("position").collect()]
    return render.compact_text(rows, found.total, a["offset"], arguments.get("details", False))


def _status(engine: Engine, arguments: dict) -> str:
    return render.status_text([r.asDict() for r in engine.status().orderBy("vol").collect()])


_TOOLS: dict[str, Callable[[Engine, dict], str]] = {"search_files": _search, "index_status": _status}


def _call(engine: Engine, params: dict) -> dict:
    tool, arguments = _TOOLS.get(params.get("name")), params.get("arguments") or {}
    if tool is None or not isinstance(arguments, dict):
        raise RpcError(BAD_PARAMS, f"no such tool: {params.get('name')}" if tool is None else "arguments must be an object")
    try:
        text, failed = tool(engine, arguments), False
    except (ValueError, SearchRefused) as e:  # told to the model, which can mend its call
        text, failed = str(e), True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def _hello(engine: Engine, params: dict) -> dict:
    asked = params.get("protocolVersion")
    return {"protocolVersion": asked if asked in REVISIONS else REVISIONS[0], "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "pathloom", "version": engine.version}}


_METHODS: dict[str, Callable[[Engine, dict], dict]] = {
    "initialize": _hello, "ping": lambda engine, params: {}, "tools/list": lambda engine, params: {"tools": catalogue()}, "tools/call": _call}


def _failure(key, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": message}}


def answer(engine: Engine, message) -> dict | list | None:
    """The reply to a message or batch; None for notifications, which get none."""
    if isinstance(message, list):
        if not message or len(message) > BATCH:
            return _failure(None, BAD_REQUEST, f"a batch holds 1 to {BATCH} messages")
        return [r for r in (answer(engine, m) for m in message) if r is not None] or None
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        key = message.get("id") if isinstance(message, dict) else None
        return None if key is None else _failure(key, BAD_REQUEST, "not a request")
    if "id" not in message:
        return None
    try:
        method = _METHODS.get(message["method"])
        if method is None:
            raise RpcError(NO_METHOD, f"no such method: {message['method']}")
        return {"jsonrpc": "2.0", "id": message["id"], "result": method(engine, message.get("params") or {})}
    except RpcError as e:
        return _failure(message["id"], e.code, str(e))


def serve(engine: Engine, lines: Iterable[str], write: Callable[[str], object]) -> None:
    """Answer one message a line until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except ValueError:
            reply = _failure(None, PARSE_ERROR, "not JSON")
        if reply is not None:
            write(render.frame(reply).decode() if isinstance(reply, dict) else json.dumps(reply, ensure_ascii=False) + "\n")
