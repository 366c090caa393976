"""Fetched files and archives against a local server: batch, stream, ranges."""

import email.utils
import http.server
import re
import threading
import zipfile

import pytest

from waymark import catalog_fetched
from waymark.sources.fetched import ArchiveLines, FetchedLines


@pytest.fixture
def server():
    """Files by name: (bytes, seconds of the last change); asked has the ranges."""
    files, asked = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body, at = files[self.path[1:]]
            part = re.fullmatch(r"bytes=(\d+)-(\d+)", self.headers.get("Range", ""))
            if part:
                asked.append((int(part[1]), int(part[2]) + 1))
                body = body[int(part[1]) : int(part[2]) + 1]
            self.send_response(206 if part else 200)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Last-Modified", email.utils.formatdate(at, usegmt=True))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", files, asked
    s.shutdown()


def test_batch_and_stream(spark, server, tmp_path):
    url, files, _ = server
    files |= {"a.csv": ("ķ1\r\n\r\nx".encode(), 1_700_000_000), "b.csv": (b"only", 1_700_000_100), "none.csv": (b"", 1_700_000_200)}
    spark.dataSource.register(FetchedLines)
    urls = " ".join(f"{url}/{n}" for n in files)
    rows = spark.read.format("waymark_lines").option("urls", urls).load()
    assert rows.rdd.getNumPartitions() == 3
    assert sorted((r["url"][len(url) + 1 :], r["stamp"], r["line"], r["value"]) for r in rows.collect()) == [("a.csv", "2023_11_14T22_13_20", 0, "ķ1"), ("a.csv", "2023_11_14T22_13_20", 1, ""), ("a.csv", "2023_11_14T22_13_20", 2, "x"), ("b.csv", "2023_11_14T22_15_00", 0, "only")]

    def run():
        q = spark.readStream.format("waymark_lines").option("urls", urls).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["url"][len(url) + 1 :], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a.csv", ""), ("a.csv", "x"), ("a.csv", "ķ1"), ("b.csv", "only")]
    assert run() == first
    files["b.csv"] = (b"new state", 1_700_000_900)
    assert run() == sorted([*first, ("b.csv", "new state")])
    assert run() == sorted([*first, ("b.csv", "new state")])  # nothing changed


def test_an_archive_is_read_by_entries_and_ranges(spark, server, tmp_path):
    url, files, asked = server
    lines = [f"line {i * 7919 % 100_003} {i}" for i in range(120_000)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("folder")
        for k in range(5):
            z.writestr(f"folder/{k}.csv", "\r\n".join(lines))
        z.writestr("empty.csv", "")
        z.writestr("latvian.csv", "ķieģelis".encode("cp1257"))
    files["x.zip"] = ((tmp_path / "x.zip").read_bytes(), 1_700_000_000)
    spark.dataSource.register(ArchiveLines)
    rows = spark.read.format("waymark_archive").option("url", f"{url}/x.zip").option("encoding", "cp1257").load()
    assert rows.rdd.getNumPartitions() == 7
    got = {r["name"]: r["n"] for r in rows.groupBy("name").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {f"folder/{k}.csv": 120_000 for k in range(5)} | {"latvian.csv": 1}
    assert rows.where("name = 'latvian.csv'").first()["value"] == "ķieģelis"
    size = len(files["x.zip"][0])
    assert size > 2 << 20 and max(b - a for a, b in asked) < size


def test_an_archive_of_a_local_path(spark, sf_dir):
    out = catalog_fetched.archive_entries(spark, sf_dir)
    assert out.rdd.getNumPartitions() == 4 and out.count() > 100
