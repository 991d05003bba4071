"""Statements over TCP: one JSON object a line each way.

A request is {"sql": ...}. Rows come as {"columns": [...]}, then {"row": [...]} for each row, then {"ok": true, ...}; a
failure is {"ok": false, "error": ...}. Values are texts, or null; nothing has to be escaped beyond JSON's own rules.
"""

from __future__ import annotations

import json
import socket
import socketserver
from collections.abc import Callable
from threading import Thread

from .errors import EngineError
from .session import Session, _text

LARGEST = 16 << 20  # bytes of a request


class Server(socketserver.ThreadingTCPServer):
    """Each connection has its thread; they share the session's tables, and Spark's scheduler shares the cluster among them."""

    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, session: Session, host: str = "127.0.0.1", port: int = 0):
        self.session = session
        super().__init__((host, port), Handler)

    def start(self) -> Server:
        Thread(target=self.serve_forever, daemon=True).start()
        return self


class Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        while line := self.rfile.readline(LARGEST):
            whole = line.endswith(b"\n")
            while not whole and (rest := self.rfile.readline(LARGEST)):  # what is too large is read to its end, so that answers stay in step
                whole, line = rest.endswith(b"\n"), b""
            try:
                if not line:
                    raise EngineError(f"the request is larger than {LARGEST} bytes")
                result = self.server.session.execute(json.loads(line)["sql"])
                if result.columns:
                    self.say(columns=result.columns)
                n = 0
                for row in result:
                    self.say(row=[_text(v) for v in row])
                    n += 1
                self.say(ok=True, rows=n, query=result.is_query, elapsed=result.elapsed)
            except EngineError as e:
                self.say(ok=False, error=str(e))
            except Exception as e:  # a connection outlives any statement
                self.say(ok=False, error=f"internal error: {e}".split("\n")[0])

    def say(self, **what: object) -> None:
        self.wfile.write(json.dumps(what).encode() + b"\n")


class Client:
    """A connection to a Server, with the callback interface of Session.execute()."""

    def __init__(self, host: str, port: int):
        self.socket = socket.create_connection((host, port))
        self.lines = self.socket.makefile("rb")
        self.last_was_query, self.last_columns = False, []

    def execute(self, sql: str, callback: Callable[[list[str | None], list[str]], object] | None = None) -> list[list[str | None]]:
        """The rows, all at once; a callback gets them one by one instead."""
        self.socket.sendall(json.dumps({"sql": sql}).encode() + b"\n")
        self.last_columns, rows, stopped = [], [], False
        for line in self.lines:
            said = json.loads(line)
            if "columns" in said:
                self.last_columns = said["columns"]
            elif "row" in said:
                if callback is None:
                    rows.append(said["row"])
                elif not stopped:
                    stopped = bool(callback(said["row"], self.last_columns))
            elif said["ok"]:
                self.last_was_query = said["query"]
                return rows
            else:
                raise EngineError(said["error"])
        raise EngineError("the connection was closed")

    def close(self) -> None:
        self.lines.close()
        self.socket.close()
