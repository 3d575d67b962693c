"""POST /query, GET /status, GET /docs and GET /docs.json over the standard library's server."""

from __future__ import annotations

import json
import logging
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import Engine, http_status
from .errors import EngineError, RequestError

log = logging.getLogger(__name__)


def _object(properties: dict, required: list[str] | None = None) -> dict:
    return {"type": "object", "properties": properties} | ({"required": required} if required else {})


def openapi() -> dict:
    whole, number, text = {"type": "integer", "format": "int64"}, {"type": "number", "format": "double"}, {"type": "string"}
    lists = {"type": "object", "additionalProperties": {"type": "array", "items": text}}
    bound = {"oneOf": [number, text]}
    one = _object({k: bound for k in ("eq", "gt", "gte", "lt", "lte")}) | {"additionalProperties": False}
    span = _object({k: whole for k in ("last_1m", "last_1h", "last_24h")})
    stats = _object({"count": whole, "sum": number, "min": number, "max": number, "oldest": text, "newest": text}, ["count"])
    schemas = {
        "QueryRequest": _object({"must": lists, "must_not": lists, "ranges": {"type": "object", "additionalProperties": {"oneOf": [one, {"type": "array", "items": one}]}}}) | {"additionalProperties": False},
        "QueryResponse": _object({"matched_rows": whole, "numeric": {"type": "object", "additionalProperties": stats}, "string_counts": {"type": "object", "additionalProperties": {"type": "object", "additionalProperties": whole}}}, ["matched_rows", "numeric"]),
        "StatusResponse": _object({"uptime_secs": whole, "rows_loaded": whole, "queries": span, "errors": span}),
        "ErrorResponse": _object({"error": text}, ["error"]),
    }
    answer = lambda name: {"description": name, "content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{name}"}}}}
    paths = {
        "/query": {"post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/QueryRequest"}}}}, "responses": {"200": answer("QueryResponse")} | {c: answer("ErrorResponse") for c in ("400", "415", "422", "500")}}},
        "/status": {"get": {"responses": {"200": answer("StatusResponse")}}},
    }
    return {"openapi": "3.1.0", "info": {"title": "quernstone", "version": "1"}, "paths": paths, "components": {"schemas": schemas}}


def serve(engine: Engine, bind: str) -> ThreadingHTTPServer:
    """A server that is bound but doesn't run yet."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, found, kind: str = "application/json") -> None:
            data = found.encode() if isinstance(found, str) else json.dumps(found, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            path = self.path.split("?")[0]
            if path == "/status":
                self._send(200, engine.status())
            elif path == "/docs.json":
                self._send(200, openapi())
            elif path in ("/docs", "/docs/"):
                self._send(200, "<!doctype html><title>quernstone</title><p>POST /query, GET /status. <a href='/docs.json'>Description</a>", "text/html")
            else:
                self._send(405 if path == "/query" else 404, {"error": "not found"})

        def do_POST(self):  # noqa: N802
            if self.path.split("?")[0] != "/query":
                self._send(404, {"error": "not found"})
                return
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            kind = (self.headers.get("Content-Type") or "").split(";")[0].strip().lower()
            try:
                if kind != "application/json" and not (kind.startswith("application/") and kind.endswith("+json")):
                    raise RequestError("expected content type application/json", 415)
                self._send(200, engine.query(raw))
            except (EngineError, ValueError) as e:
                status = http_status(e)
                if status == 500:
                    log.error("query failed: %s", e)
                self._send(status, {"error": str(e)})

        def log_message(self, *args):
            log.debug(*args)

    host, _, port = bind.rpartition(":")
    return ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
