"""One statement per line over TCP, replies in the style of RESP.

    python -m quillon.server --port 7878 --db quillon.db
"""

from __future__ import annotations

import argparse
import socketserver

from pyspark.sql import SparkSession

from quillon.engine import Done, Engine, Inserted, Result, Session
from quillon.errors import DbError, InternalError


def render(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _strings(items: list[str]) -> bytes:
    out = f"*{len(items)}\r\n".encode()
    for x in items:
        raw = x.encode()
        out += b"$%d\r\n%s\r\n" % (len(raw), raw)
    return out


def encode_result(result: Result) -> bytes:
    if isinstance(result, Done):
        return b"+OK\r\n"
    if isinstance(result, Inserted):
        return b":%d\r\n" % result.count
    rows = result.fetch()
    return b"*%d\r\n" % (len(rows) + 1) + _strings(result.columns) + b"".join(_strings([render(v) for v in r]) for r in rows)


def encode_error(message: str) -> bytes:
    return f"-ERR {message.replace(chr(13), ' ').replace(chr(10), ' ')}\r\n".encode()


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, address: tuple[str, int], engine: Engine):
        super().__init__(address, Connection)
        self.engine = engine


class Connection(socketserver.StreamRequestHandler):
    """Closing it drops its session, and so rolls back."""

    def handle(self) -> None:
        session = Session()
        for raw in self.rfile:
            sql = raw.decode("utf-8", "replace").strip()
            if not sql:
                continue
            try:
                reply = encode_result(self.server.engine.execute(sql, session))
            except DbError as e:
                reply = encode_error(str(e))
            except Exception as e:  # whatever fails in Spark or on disk; the session goes on
                reply = encode_error(str(InternalError(f"{type(e).__name__}: {e}")))
            try:
                self.wfile.write(reply)
            except OSError:
                return


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--port", type=int, default=7878)
    args.add_argument("--db", default="quillon.db")
    given = args.parse_args()
    engine = Engine(SparkSession.builder.appName("quillon").getOrCreate(), given.db)
    with Server(("127.0.0.1", given.port), engine) as server:
        try:
            server.serve_forever()
        finally:
            engine.checkpoint()
            engine.close()


if __name__ == "__main__":
    main()
