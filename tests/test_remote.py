import itertools
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from scriptorium.sources.remote import Answer, fetch_pages, http_get, import_shared, snapshots_of
from scriptorium.sources.snapshots import import_snapshots

HTML = {"content-type": "text/html"}
PAGE = '<title>T</title><article data-message-author-role="user"><p>Hello</p></article>'
TIME = "2024-01-01T00:00:00.000Z"


def server():
    """The function that answers; made here, so that workers need not import this module."""

    def serve(url, timeout, row):
        """What the row says, by url; a number is a status and a text that begins with a slash or a scheme a place to go to."""
        said = json.loads(row["said"])
        what = said.get(url.removeprefix("https://chatgpt.com"), said.get("*"))
        if what == "slow":
            raise TimeoutError
        if what == "endless":
            return Answer(200, HTML, itertools.repeat(b"x" * 1000))
        if isinstance(what, int):
            return Answer(what, HTML, iter([b"x"]))
        if what.startswith(("/", "http")):
            return Answer(302, {"location": what}, iter(()))
        return Answer(200, HTML, iter([what[:5].encode(), what[5:].encode()]))

    return serve


def test_rules_of_requests_and_redirects(spark, tmp_path):
    url = "https://chatgpt.com/share/a"
    cases = [
        (url, {"*": PAGE}, None), (url, {"/share/a": "/share/b", "/share/b": "https://chatgpt.com/share/c", "/share/c": PAGE}, None), (url, {"*": "/share/a"}, "too many redirects"),
        (url, {"*": "https://evil.com/share/a"}, "redirect not allowed"), (url, {"*": "http://chatgpt.com/share/a"}, "redirect not allowed"), (url, {"*": "/else"}, "redirect not allowed"), (url, {"*": 500}, "status 500"), (url, {"*": 304}, "redirect without a location"),
        (url, {"*": "slow"}, "timed out"), (url, {"*": "endless"}, "too large"), (url, {"*": "x" * 301}, "too large"), (url, {"*": "x" * 300}, None), ("https://chatgpt.com/share/a?q=1", {"*": PAGE}, "url not allowed"), (None, {"*": PAGE}, "url not allowed"), ("nonsense", {"*": PAGE}, "url not allowed"),
    ]
    rows = spark.createDataFrame([(i, u, json.dumps(said)) for i, (u, said, _) in enumerate(cases)], "archive_id long, url string, said string")
    fetch_pages(rows, server(), max_bytes=300).coalesce(1).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    got = {r.archive_id: r for r in pages.collect()}
    assert [got[i].error for i in range(len(cases))] == [error for _, _, error in cases]
    assert all((r.html_bytes is None) == (r.error is not None) for r in got.values()) and bytes(got[1].html_bytes) == PAGE.encode()
    assert {r.name[:9] for r in snapshots_of(pages, TIME).collect()} == {"snapshot-"} and import_snapshots(snapshots_of(pages.filter("archive_id < 2"), TIME))[2].count() == 0
    archives, events, bad = import_shared(pages, TIME)
    assert {(r.archive_id, r.capture_method) for r in archives.collect()} == {(0, "public_shared_link"), (1, "public_shared_link")} and {r.content for r in events.collect()} == {"Hello"}
    assert {r.archive_id for r in bad.collect()} == set(range(2, len(cases)))
    with pytest.raises(ValueError):
        fetch_pages(rows, server(), timeout=11)


def test_http_get_follows_nothing():
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(302 if self.path == "/go" else 404 if self.path == "/no" else 200)
            self.send_header("Content-Type", "text/html")
            self.send_header("Location", "/there")
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for path, status in (("/go", 302), ("/no", 404), ("/", 200)):
            a = http_get(f"http://127.0.0.1:{server.server_port}{path}", 5, {})
            assert (a.status, a.headers["content-type"], b"".join(a.chunks)) == (status, "text/html", b"body")
    finally:
        server.shutdown()
