import threading

import pytest

from quillon.client import Client, ServerError, shown, table
from quillon.engine import Engine
from quillon.server import Server, encode_error, render


@pytest.fixture
def server(spark):
    with Server(("127.0.0.1", 0), Engine(spark)) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield s.server_address[1]
        s.shutdown()


def test_conversation(server):
    c, other = Client(port=server), Client(port=server)
    assert c.execute("CREATE TABLE t (id INT, v VARCHAR)") == "OK"
    assert c.execute("INSERT INTO t VALUES (1, 'é')") == 1
    assert c.execute("SELECT V, id FROM t") == [["v", "id"], ["é", "1"]]
    error = c.execute("SELECT * FROM nowhere")
    assert isinstance(error, ServerError) and str(error) == "Table 'nowhere' does not exist"
    for sql in ("SELECT * FROM t WHERE id = " + "9" * 5000, "INSERT INTO t VALUES (" + "0" * 5000 + "2147483648)"):
        assert isinstance(c.execute(sql), ServerError)
    assert c.execute("BEGIN") == "OK" and c.execute("INSERT INTO t VALUES (2, 'b')") == 1
    c.close()  # rolls back
    assert other.execute("SELECT id FROM t") == [["id"], ["1"]]
    other.close()


def test_any_failure_is_answered(server, monkeypatch):
    c = Client(port=server)
    c.execute("CREATE TABLE t (id INT)")
    monkeypatch.setattr(Engine, "execute", lambda *_: 1 / 0)
    assert str(c.execute("SELECT * FROM t")) == "Internal error: ZeroDivisionError: division by zero"
    monkeypatch.undo()
    assert c.execute("SELECT * FROM t") == [["id"]]
    c.close()


def test_rendering():
    assert [render(x) for x in (True, -3, "a")] == ["true", "-3", "a"]
    assert encode_error("a\r\nb") == b"-ERR a  b\r\n"
    assert table([["id", "v"], ["1", "xyz"]]) == "| id | v   |\n|----|-----|\n| 1  | xyz |\n(1 row)"
    assert shown(2) == "(2 rows affected)" and shown(1) == "(1 row affected)" and shown(ServerError("x")) == "(error) x" and shown("OK") == "OK"
