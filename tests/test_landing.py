"""Landing against a server on this machine that fails, redirects, truncates and changes."""

from __future__ import annotations

import datetime
import http.server
import json
import threading

import pytest

from actaflow.sources import landing
from actaflow.sources.gazette import day_results

XML = "<documento><metadatos><identificador>{}</identificador></metadatos></documento>"


class Server(http.server.ThreadingHTTPServer):
    """Paths answer by their first word; ``asked`` counts requests by path."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.asked: dict[str, int] = {}
        self.bodies: dict[str, bytes] = {}
        self.lock = threading.Lock()


class Handler(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    def log_message(self, *_):
        pass

    def answer(self, status, body=b"", **fields):
        self.send_response(status)
        for name, value in fields.items():
            self.send_header(name.replace("_", "-"), value)
        if "Content_Length" not in fields:
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        path = self.path
        with self.server.lock:
            n = self.server.asked[path] = self.server.asked.get(path, 0) + 1
        body = self.server.bodies.get(path, XML.format(path).encode())
        kind = path.split("/")[1]
        if kind == "index":
            return self.answer(200, body) if path in self.server.bodies else self.answer(404)
        if kind == "busy" and n < 3:
            return self.answer(503)
        if kind == "slow" and n < 2:
            return self.answer(429, Retry_After="0")
        if kind == "never":
            return self.answer(429, Retry_After="9999")
        if kind == "denied":
            return self.answer(403)
        if kind == "moved":
            return self.answer(301, Location="/plain/" + path.split("/")[2])
        if kind == "cut" and n < 2:
            self.answer(200, body[:20], Content_Length=str(len(body)))
            self.close_connection = True
            return None
        if kind == "broken":
            return self.answer(200, b"<documento>")
        if kind == "tagged":
            tag = f'"{hash(body)}"'
            return self.answer(304) if self.headers.get("If-None-Match") == tag else self.answer(200, body, ETag=tag)
        return self.answer(200, body)


@pytest.fixture
def server():
    s = Server()
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()
    s.server_close()


def address(server, path):
    return f"http://127.0.0.1:{server.server_address[1]}{path}"


def index(server, day, *kinds):
    items = [{"identificador": f"GZ-A-{day}-{i}", "titulo": f"PROVINCE {i}", "url_xml": address(server, f"/{k}/{day}{i}")} for i, k in enumerate(kinds)]
    items.append({"identificador": "X", "titulo": "ÍNDICE ALFABÉTICO", "url_xml": address(server, "/plain/x")})
    server.bodies[f"/index/{day}"] = json.dumps({"data": {"sumario": {"diario": {"seccion": [{"codigo": "A", "item": items if len(items) > 2 else items[0]}, {"codigo": "Z", "item": items}]}}}}).encode()


FAST = {"first": 0.01, "pause": 0.0, "timeout": 5.0}


def test_a_range_of_days_is_landed_and_recovered(spark, server, tmp_path):
    index(server, "20240102", "busy", "slow", "moved", "cut", "plain")
    index(server, "20240103", "denied", "never", "broken", "plain")
    server.bodies["/index/20240104"] = b"{}"
    run = lambda **more: landing.land(spark, str(tmp_path), address(server, "/index/{day}"), "2024-01-01", "2024-01-04", **FAST, **more)
    rows = {(r.day.day, r.doc_id and r.doc_id[-1]): r for r in run(content=True).collect()}
    assert rows[1, None].status == "no_gazette" and server.asked["/index/20240101"] == 1
    good = [rows[2, str(i)] for i in range(5)]
    assert [(r.status, r.attempts) for r in good] == [("published", n) for n in (3, 2, 1, 2, 1)] and all(landing.well_formed(bytes(r.content)) is None for r in good)
    assert good[0].waited >= 0.03 and good[0].n_bytes == len(good[0].content) and not any(r.from_store for r in good)
    bad = [rows[3, str(i)] for i in range(3)]
    assert [(r.status, r.attempts) for r in bad] == [("failed", 1), ("failed", 1), ("failed", 5)] and "status 403" in bad[0].error and "not well formed" in bad[2].error
    assert rows[3, "3"].status == "published" and rows[4, None].status == "failed" and "not an index" in rows[4, None].error
    days = {r.day.day: (r.status, r.n_documents) for r in day_results(run().select("day", "status", "error")).collect()}
    assert days == {1: ("no_gazette", 0), 2: ("published", 5), 3: ("failed", 1), 4: ("failed", 0)}
    # what has landed is not asked for again; what failed is, and recovers
    server.bodies["/broken/202401032"], before = b"", server.asked["/plain/202401024"]
    index(server, "20240103", "denied", "never", "broken", "plain")
    for r in run().filter("day = date'2024-01-02'").collect():
        assert r.from_store and r.attempts == 0
    assert server.asked["/plain/202401024"] == before == 1
    offline = {(r.day.day, r.doc_id and r.doc_id[-1]): r.status for r in run(offline=True).collect()}
    assert offline[2, "0"] == "published" and offline[3, "0"] == "not_cached" and offline[1, None] == "not_cached"


def test_changed_and_damaged_payloads(server, tmp_path):
    url, store = address(server, "/tagged/1"), landing.Store(f"file://{tmp_path}")
    way = lambda **more: landing.Landing(store, landing.Rules(first=0.01, pause=0.0), **more)
    first = way().fetch(url, landing.well_formed)
    assert not first[2] and way(revalidate=True).fetch(url, landing.well_formed) == (first[0], first[1], True) and server.asked["/tagged/1"] == 2
    server.bodies["/tagged/1"] = b"<documento>new</documento>"
    assert way().fetch(url, landing.well_formed)[0] == first[0]
    assert way(revalidate=True).fetch(url, landing.well_formed)[0] == b"<documento>new</documento>"
    path = tmp_path / store._payload(store.note(url)["digest"])
    path.write_bytes(b"damaged")
    assert store.get(url) is None and way().fetch(url, landing.well_formed)[0] == b"<documento>new</documento>"
    with pytest.raises(landing.Refused):
        way(offline=True).fetch(address(server, "/plain/none"), landing.well_formed)
    assert server.asked.get("/plain/none") is None


def test_waits():
    rules = landing.Rules(first=2.0, most=60.0)
    assert [rules.delay(n) for n in range(1, 8)] == [2, 4, 8, 16, 32, 60, 60]
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    assert landing.asked_wait("Mon, 01 Jan 2024 00:02:00 GMT", now) == 120 and landing.asked_wait(" 7 ") == 7
    assert landing.asked_wait("Sun, 31 Dec 2023 00:00:00 GMT", now) == 0 and landing.asked_wait("soon") is None and landing.asked_wait(None) is None


def test_requests_keep_their_distance(server, tmp_path):
    waits = []
    way = landing.Landing(landing.Store(str(tmp_path)), landing.Rules(pause=5.0), sleep=waits.append)
    way.fetch(address(server, "/plain/1"), landing.well_formed)
    way.fetch(address(server, "/plain/2"), landing.well_formed)
    assert len(waits) == 1 and 4 < waits[0] <= 5


def test_missing_options_are_named(spark):
    spark.dataSource.register(landing.GazetteLanding)
    with pytest.raises(Exception, match="options missing: end, index, root, start"):
        spark.read.format("gazette_landing").load().collect()
