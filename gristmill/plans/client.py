"""Client interfaces to an engine: a DB-API 2.0 connection and procedure calls over HTTP as JSON."""

from __future__ import annotations

import datetime
import decimal
import json
import threading
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

apilevel, threadsafety, paramstyle = "2.0", 1, "named"


class Error(Exception):
    """Any failure of a statement or call."""


class Cursor:
    """Rows come from the result partition by partition as they are fetched, so a large result is never held whole."""

    arraysize = 1

    def __init__(self, engine: object):
        self.engine = engine
        self.description: list[tuple] | None = None
        self.rowcount = -1
        self._rows: Iterator = iter(())

    def _take(self, df: DataFrame | None) -> None:
        if isinstance(df, DataFrame):
            self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema.fields]
            self._rows = df.toLocalIterator()
        else:
            self.description, self._rows = None, iter(())

    def execute(self, sql: str, parameters: dict | None = None) -> None:
        try:
            self._take(self.engine.sql(sql, **(parameters or {})))
        except Exception as e:
            raise Error(str(e)) from e

    def callproc(self, name: str, parameters: tuple = ()) -> tuple:
        try:
            self._take(self.engine.call(name, *parameters))
        except Exception as e:
            raise Error(str(e)) from e
        return parameters

    def fetchone(self) -> tuple | None:
        row = next(self._rows, None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        return [tuple(r) for _, r in zip(range(size or self.arraysize), self._rows)]

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._rows]

    def close(self) -> None:
        self._rows = iter(())


class Connection:
    def __init__(self, engine: object):
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self.engine)

    def commit(self) -> None:
        """Every statement is a transaction of its own."""

    def close(self) -> None:
        self.engine = None


def connect(engine: object) -> Connection:
    return Connection(engine)


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def call_json(engine: object, name: str, parameters: str = "[]", most_rows: int = 100_000) -> dict:
    """The answer to a procedure call: status 1 and result tables, or a negative status and a message.

    A response holds at most ``most_rows`` rows; more is an error, not a cut.
    """
    try:
        if name not in engine.procedures:
            raise Error(f"no procedure {name}")
        given = json.loads(parameters)
        result = engine.call(name, **given) if isinstance(given, dict) else engine.call(name, *given)
        results = []
        for df in result if isinstance(result, list) else [result]:
            if isinstance(df, DataFrame):
                rows = df.limit(most_rows + 1).collect()
                if len(rows) > most_rows:
                    raise Error(f"more than {most_rows} rows")
                results.append({"schema": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], "data": [[_plain(v) for v in r] for r in rows]})
        return {"status": 1, "statusstring": None, "results": results}
    except Exception as e:
        return {"status": -1, "statusstring": str(e), "results": []}


class Server:
    """GET or POST /api/1.0/ with Procedure and Parameters (a JSON list, or an object for named ones)."""

    def __init__(self, engine: object, host: str = "127.0.0.1", port: int = 0):
        class Handler(BaseHTTPRequestHandler):
            def _answer(self, fields: dict[str, list[str]]) -> None:
                body = json.dumps(call_json(engine, fields.get("Procedure", [""])[0], fields.get("Parameters", ["[]"])[0])).encode()
                self.send_response(200)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:
                self._answer(parse_qs(urlsplit(self.path).query))

            def do_POST(self) -> None:
                self._answer(parse_qs(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()))

            def log_message(self, *_: object) -> None:
                pass

        self._server = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self._server.server_address[1]}/api/1.0/"
        self._thread = threading.Thread(target=self._server.serve_forever, daemon=True)

    def __enter__(self) -> Server:
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._server.shutdown()
        self._server.server_close()
