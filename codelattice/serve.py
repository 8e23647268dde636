"""The answers over standard input and output: one JSON-RPC 2.0 message a line, with the tools of the Model Context Protocol.

A refresh of the index starts with the first question; each answer is told what it may lack.
"""

from __future__ import annotations

import inspect
import json
import sys
from typing import IO

from . import __version__
from .api import CAPS, CodeIndex
from .streaming.freshness import Freshness

#: Fixed value: the revision of the protocol that is spoken.
PROTOCOL = "2025-06-18"
_TYPES = {"str": "string", "int": "integer", "bool": "boolean"}
_BAD_REQUEST, _NO_METHOD, _BAD_PARAMS = -32600, -32601, -32602


def tool(name: str) -> dict:
    """Name, description and schema of one question, out of its signature."""
    properties, required = {}, []
    for p in list(inspect.signature(getattr(CodeIndex, name)).parameters.values())[1:]:
        properties[p.name] = {"type": _TYPES[str(p.annotation).split(" ")[0]]}
        if p.default is p.empty:
            required.append(p.name)
    return {"name": name, "description": inspect.getdoc(getattr(CodeIndex, name)), "inputSchema": {"type": "object", "properties": properties, "required": required}}


class Server:
    def __init__(self, code: CodeIndex):
        self.code = code
        self.freshness = Freshness(code.refresh, code.index.published)

    def answer(self, name: str, arguments: dict) -> tuple[str, bool]:
        """The text, and whether it is an error."""
        seen = self.freshness.look()
        if seen.index is None:
            return seen.remark, True
        try:
            text = getattr(self.code, name)(**arguments)
        except Exception as e:  # whoever asks is told, and the server goes on
            return f"{type(e).__name__}: {e}", True
        return text + (f"\n({seen.remark})" if seen.remark else ""), False

    def reply(self, message: dict) -> dict | None:
        """The response to a request; None for a notification."""
        method, key, params = message.get("method"), message.get("id"), message.get("params") or {}
        if key is None:
            return None
        result: dict | None = None
        error: tuple[int, str] | None = None
        if method == "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codelattice", "version": __version__}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": [tool(n) for n in CAPS]}
        elif method == "tools/call":
            name, arguments = params.get("name"), params.get("arguments") or {}
            known = tool(name)["inputSchema"] if name in CAPS else None
            if known is None or set(arguments) - set(known["properties"]) or set(known["required"]) - set(arguments):
                error = _BAD_PARAMS, f"no such tool, or other arguments: {name}"
            else:
                text, failed = self.answer(name, arguments)
                result = {"content": [{"type": "text", "text": text}], "isError": failed}
        else:
            error = (_NO_METHOD, f"no method {method}") if method else (_BAD_REQUEST, "not a request")
        return {"jsonrpc": "2.0", "id": key} | ({"result": result} if error is None else {"error": {"code": error[0], "message": error[1]}})

    def serve(self, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
        for line in source:
            if line.strip():
                try:
                    message = json.loads(line)
                except json.JSONDecodeError:
                    message = {"id": 0}
                response = self.reply(message if isinstance(message, dict) else {"id": 0})
                if response is not None:
                    sink.write(json.dumps(response, ensure_ascii=False) + "\n")
                    sink.flush()
