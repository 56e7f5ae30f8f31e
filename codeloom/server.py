"""Line-delimited JSON-RPC over two streams, a thin layer on the engine."""

from __future__ import annotations

import json
from pathlib import Path
from typing import TextIO

from codeloom.engine import Engine
from codeloom.sinks.files import below

TOOLS = {
    "wiki_index": ("The list of articles", []), "wiki_article": ("One article", ["path"]), "search": ("Nodes by a part of their label", ["term"]), "path": ("The shortest path between two nodes", ["source", "target"]),
    "blast_radius": ("What a change of a node reaches", ["node"]), "routes": ("Routes", []), "services": ("Classes", []),
}


class Server:
    def __init__(self, engine: Engine, wiki: str | None = None):
        self.engine, self.wiki = engine, Path(wiki) if wiki else None

    def call(self, name: str, args: dict) -> str:
        _, needed = TOOLS[name]
        missing = [k for k in needed if not str(args.get(k) or "").strip()]
        if missing:
            return f"Error: {', '.join(missing)} must not be empty"
        if name.startswith("wiki"):
            return self._wiki(args.get("path"))
        if name == "search":
            found = self.engine.search(args["term"], int(args.get("limit", 20)))
        elif name == "path":
            found = self.engine.path(args["source"], args["target"]).orderBy("place")
        elif name == "blast_radius":
            found = self.engine.blast_radius(args["node"], int(args.get("depth", 2))).orderBy("direction", "depth", "id")
        elif name == "routes":
            found = self.engine.routes(args.get("project"), int(args.get("limit", 50)))
        else:
            found = self.engine.services(args.get("project"), int(args.get("limit", 50)))
        lines = ("- " + ", ".join(str(v) for v in row if v is not None) for row in found.toLocalIterator())  # a partition at a time
        return "\n".join(lines) or "Nothing found"

    def _wiki(self, path: str | None) -> str:
        if self.wiki is None or not self.wiki.is_dir():
            return "No wiki"
        if path is None:
            return "\n".join(sorted(str(p.relative_to(self.wiki)) for p in self.wiki.rglob("*.md")))
        file = self.wiki / path
        return file.read_text(encoding="utf-8") if below(path) and file.is_file() else "No such article"

    def answer(self, line: str) -> dict | None:
        try:
            asked = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
        ident, method, params = asked.get("id"), asked.get("method"), asked.get("params") or {}
        if ident is None:
            return None
        reply: dict = {"jsonrpc": "2.0", "id": ident}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": "0.1.0"}}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": text, "inputSchema": {"type": "object", "required": needed}} for n, (text, needed) in TOOLS.items()]}}
        if method == "tools/call":
            if params.get("name") not in TOOLS:
                return reply | {"error": {"code": -32601, "message": f"Unknown tool {params.get('name')}"}}
            try:
                return reply | {"result": {"content": [{"type": "text", "text": self.call(params["name"], params.get("arguments") or {})}]}}
            except Exception as e:  # noqa: BLE001
                return reply | {"error": {"code": -32603, "message": str(e)[:500]}}
        return reply | {"error": {"code": -32601, "message": f"Unknown method {method}"}}

    def run(self, source: TextIO, out: TextIO) -> None:
        for line in source:
            if line.strip() and (reply := self.answer(line)) is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()
