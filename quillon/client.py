"""A line client for the server.

    python -m quillon.client --host 127.0.0.1 --port 7878
"""

from __future__ import annotations

import argparse
import socket
from typing import BinaryIO


class ServerError(Exception):
    pass


def read_reply(stream: BinaryIO) -> object:
    """A str, an int, a list, or a ``ServerError`` as a value."""
    line = stream.readline()
    if not line:
        raise ConnectionError("server closed the connection")
    mark, rest = line[:1], line[1:].rstrip(b"\r\n").decode()
    if mark == b"+":
        return rest
    if mark == b"-":
        return ServerError(rest.removeprefix("ERR "))
    if mark == b":":
        return int(rest)
    if mark == b"$":
        return stream.read(int(rest) + 2)[:-2].decode()
    if mark == b"*":
        return [read_reply(stream) for _ in range(int(rest))]
    raise ValueError(f"unknown reply {mark!r}")


def table(rows: list[list[str]]) -> str:
    """Rows aligned in columns, the first being the header."""
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    text = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)) + " |" for r in rows]
    text.insert(1, "|-" + "-|-".join("-" * w for w in widths) + "-|")
    n = len(rows) - 1
    return "\n".join([*text, f"({n} row{'' if n == 1 else 's'})"])


def shown(reply: object) -> str:
    if isinstance(reply, ServerError):
        return f"(error) {reply}"
    if isinstance(reply, int):
        return f"({reply} row{'' if reply == 1 else 's'} affected)"
    return table(reply) if isinstance(reply, list) else str(reply)


class Client:
    def __init__(self, host: str = "127.0.0.1", port: int = 7878):
        self.socket = socket.create_connection((host, port))
        self.stream = self.socket.makefile("rb")

    def execute(self, sql: str) -> object:
        self.socket.sendall(" ".join(sql.splitlines()).encode() + b"\n")
        return read_reply(self.stream)

    def close(self) -> None:
        self.stream.close()
        self.socket.close()


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--host", default="127.0.0.1")
    args.add_argument("--port", type=int, default=7878)
    given = args.parse_args()
    client = Client(given.host, given.port)
    while True:
        try:
            line = input("quillon> ").strip()
        except EOFError:
            break
        if line.lower() in ("exit", "quit"):
            break
        if line:
            print(shown(client.execute(line)))
    client.close()


if __name__ == "__main__":
    main()
