"""Downloads from a local server, the state's commits, and archives that are read by member."""

import io
import json
import os
import threading
import time
import zipfile
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError

from sedgeline import __main__ as command
from sedgeline import runs
from sedgeline.sources import archives, download, stores, tables


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(f"{name}.csv", content)
    return out.getvalue()


GOOD = zipped(a="x,y\n1,2\n")


class Server(ThreadingHTTPServer):
    """Answers by the path /<item>/<year>: a list of (code, body) for each, the last of them again and again."""

    def __init__(self):
        self.asked, self.answers = Counter(), {}
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_address[1]}"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        n = self.server.asked[self.path]
        self.server.asked[self.path] += 1
        answers = self.server.answers.get(self.path, [(200, GOOD)])
        code, body = answers[min(n, len(answers) - 1)]
        if code == "slow":
            time.sleep(1.5)
            code = 200
        self.send_response(code)
        self.send_header("Content-Length", str(len(body) + (10 if code == 206 else 0)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    found = Server()
    yield found
    found.shutdown()


def settings(server, **other):
    return download.Settings(server.url + "/{item_code}/{fiscal_year}", **{"backoff": 0.01, "limited_wait": 0.02, "timeout": 0.5, "delay": 0.0} | other)


def test_fetch_tells_answers_apart(server):
    waits = []
    for path, answers in {
        "ok": [(200, GOOD)],
        "none": [(404, b"")],
        "empty": [(200, b"")],
        "html": [(200, b"<html>")],
        "limited": [(429, b""), (200, GOOD)],
        "always_limited": [(429, b"")],
        "broken": [(500, b""), (503, b""), (200, GOOD)],
        "always_broken": [(502, b"")],
        "denied": [(403, b"")],
        "slow": [("slow", GOOD), (200, GOOD)],
        "cut_off": [(206, GOOD)],
    }.items():
        server.answers[f"/{path}"] = answers
    got = {p: download.fetch(f"{server.url}/{p}", settings(server, backoff=5.0, limited_wait=60.0), sleep=waits.append) for p in [x[1:] for x in server.answers]}
    told = {p: (o.status, o.reason, o.http, o.attempts) for p, o in got.items()}
    assert told == {
        "ok": ("completed", None, 200, 1), "none": ("skipped_empty", "not_found", 404, 1), "empty": ("skipped_empty", "empty", 200, 1),
        "html": ("skipped_empty", "not_zip", 200, 1), "limited": ("completed", None, 200, 2), "always_limited": ("failed", "rate_limited", 429, 3),
        "broken": ("completed", None, 200, 3), "always_broken": ("failed", "http_502", 502, 3), "denied": ("failed", "http_403", 403, 1),
        "slow": ("completed", None, 200, 2), "cut_off": ("failed", "connection", None, 1),
    }
    assert got["ok"].content == GOOD and got["html"].content is None
    assert waits == [60.0, 60.0, 60.0, 5.0, 10.0, 5.0, 10.0, 5.0]
    server.shutdown()
    server.server_close()
    assert download.fetch(f"{server.url}/ok", settings(server)).reason == "connection"


def tasks_of(n):
    return [{"output_path": f"dataset/c/item_{i:03d}/2011.zip", "item_code": i, "fiscal_year": 2011} for i in range(n)]


def test_a_partition_for_each_task(spark, server, tmp_path):
    found = download.downloads(spark, tasks_of(7), settings(server))
    assert found.rdd.getNumPartitions() == 7 and sorted(r.item_code for r in found.collect()) == list(range(7))
    place = tmp_path / "dataset/c/item_001"
    place.mkdir(parents=True)
    (place / "2011.zip").write_bytes(GOOD)
    server.asked.clear()
    rows = {r.item_code: r for r in download.downloads(spark, tasks_of(3), settings(server), root=str(tmp_path)).collect()}
    assert (rows[1].status, rows[1].reason, rows[1].content, rows[1].bytes) == ("completed", "existing", None, len(GOOD))
    assert server.asked == {"/0/2011": 1, "/2/2011": 1} and bytes(rows[0].content) == GOOD


def save_catalog(path, items=3):
    path.write_text(json.dumps({"data": [{"item_code": i, "class_code": 3, "content_code": 1} for i in range(1, items + 1)] + [{"item_code": 9, "class_code": 3, "content_code": 2}]}))
    return str(path)


def test_download_run_goes_on(spark, server, tmp_path):
    catalog = save_catalog(tmp_path / "catalog.json")
    server.answers |= {"/1/2012": [(404, b"")], "/2/2011": [(500, b""), (500, b""), (500, b""), (200, GOOD)]}
    where = {"root": str(tmp_path), "state": str(tmp_path / "state"), "first_year": 2011, "last_year": 2012}
    made = runs.download_archives(spark, catalog, settings(server), connections=4, **where)
    assert (made["items_downloaded"], made["files_completed"], made["files_skipped_empty"], made["files_failed"]) == (3, 4, 1, 1)
    assert tables.read_json(spark, f"{tmp_path}/dataset/_manifest") == made
    assert (tmp_path / "dataset/03_walk_survey/item_003/2012.zip").read_bytes() == GOOD
    assert not [f for f in (tmp_path / "dataset").rglob("*") if f.name.endswith(".tmp")]
    state = {r.output_path[-20:]: r for r in archives.current_state(spark, where["state"]).collect()}
    assert state["ey/item_001/2012.zip"].reason == "not_found"
    asked = dict(server.asked)
    made = runs.download_archives(spark, catalog, settings(server), **where)
    assert (made["files_completed"], made["files_failed"]) == (5, 0)
    assert {p: n - asked[p] for p, n in server.asked.items() if n != asked[p]} == {"/2/2011": 1}


def test_state_appears_whole_or_not_at_all(spark, server, tmp_path):
    state, root = str(tmp_path / "state"), str(tmp_path)
    download.store(download.downloads(spark, tasks_of(2), settings(server), root=root), state, root)
    before = sorted(r.output_path for r in archives.current_state(spark, state).collect())

    def dies(batches):
        for batch in batches:
            if batch.column("item_code").to_pylist() == [3]:
                time.sleep(2)
                os._exit(9)  # as a lost worker: no clean-up, no message
            yield batch

    fetched = download.downloads(spark, tasks_of(6), settings(server), root=root)
    with pytest.raises(Py4JJavaError):
        download.store(fetched.mapInArrow(dies, fetched.schema), state, root)
    assert sorted(r.output_path for r in archives.current_state(spark, state).collect()) == before
    assert archives.current_state(spark, str(tmp_path / "none")).collect() == []
    server.asked.clear()
    download.store(download.downloads(spark, tasks_of(6), settings(server), root=root), state, root)
    found = {r.output_path: r for r in archives.current_state(spark, state).collect()}
    there = {f.relative_to(tmp_path).as_posix() for f in (tmp_path / "dataset").rglob("*.zip")}
    assert len(found) == 6 and {r.status for r in found.values()} == {"completed"} and there == set(found)
    assert max(server.asked.values()) == 1 and len(server.asked) <= 4


def test_parts_without_a_commit_do_not_count(spark, tmp_path):
    state = str(tmp_path / "state")
    rows = "output_path string, status string, error string"
    archives.record_state(spark.createDataFrame([("a", "failed", "x"), ("b", "completed", None)], rows), state)
    archives.record_state(spark.createDataFrame([("a", "completed", None)], rows), state)
    Path(state, "parts", "stray.json").write_text('{"output_path": "c", "status": "completed", "at": "2030-01-01T00:00:00Z"}')
    assert {(r.output_path, r.status, r.error) for r in archives.current_state(spark, state).collect()} == {("a", "completed", None), ("b", "completed", None)}
    messages = download._Writer({"state": state}).write(iter([pa.RecordBatch.from_pylist([{"output_path": "d", "status": "failed"}])]))
    assert Path(state, "parts", messages.name).exists()
    download._Writer({"state": state}).abort([messages, None])
    assert not Path(state, "parts", messages.name).exists()


def test_command_line_download(spark, server, tmp_path, capsys):
    server.answers["/catalog"] = [(200, Path(save_catalog(tmp_path / "c.json", 2)).read_bytes())]
    server.answers["/bad"] = [(200, b"{}")]
    line = ["--verbose", "download", "--catalog", f"{server.url}/catalog", "--url", server.url + "/{item_code}/{fiscal_year}", "--root", str(tmp_path / "r"), "--state", str(tmp_path / "s")]
    line += ["--year-start", "2011", "--year-end", "2011", "--delay", "0"]
    assert command.main([*line, "--dry-run"]) == 0
    assert capsys.readouterr().out.count("2011.zip") == 2 and "/1/2011" not in server.asked
    assert command.main(line) == 0 and "files_completed: 2" in capsys.readouterr().out
    assert command.main([*line, "--year-start", "2012"]) == 1
    with pytest.raises(ValueError, match="data"):
        runs.fetch_catalog(spark, f"{server.url}/bad", str(tmp_path / "x"))


def csv_text(rows, width=37):
    lines = [",".join(f"h{i}" for i in range(width))]
    for mesh, day, value in rows:
        cells = [""] * width
        cells[11], cells[12], cells[32], cells[0] = day, value, mesh, "空間線量率"
        lines.append(",".join(cells))
    return "\n".join(lines)


@pytest.fixture
def dataset(tmp_path):
    folder = tmp_path / "02_drive_survey" / "item_001"
    folder.mkdir(parents=True)
    good = csv_text([(f"m{i}", "2012-04-01", str(i)) for i in range(500)])
    content = bytearray(zipped(a=good, b=good.replace("m1", "k1"), c=good))
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        at = z.getinfo("b.csv").header_offset
    content[at + 200] ^= 0xFF  # inside the deflated member b
    (folder / "2012.zip").write_bytes(bytes(content))
    (folder / "2013.zip").write_bytes(zipped(a=good.encode("shift_jis")))
    (folder / "2014.zip").write_bytes(b"PK no archive")
    other = tmp_path / "03_walk_survey" / "item_002"
    other.mkdir(parents=True)
    (other / "2012.zip").write_bytes(zipped(a=good, b='x,"y'))
    return tmp_path


def audit_of(found):
    return sorted((r.path[-17:-4], r.member or "", r.status, r.rows) for r in archives.file_audit(found).collect())


def test_a_damaged_member_leaves_the_others(spark, dataset):
    rows = audit_of(archives.read_archives(spark, str(dataset)))
    assert [r[1:] for r in rows if r[0] == "item_001/2012"] == [("a.csv", "ok", 500), ("b.csv", "corrupt", 0), ("c.csv", "ok", 500)]
    assert [r[1:] for r in rows if r[0] == "item_001/2014"] == [("", "corrupt", 0)]
    assert [r[1:] for r in rows if r[0] == "item_002/2012"] == [("a.csv", "ok", 500), ("b.csv", "malformed", 0)]
    gone = dataset / "03_walk_survey" / "item_002" / "2012.zip"
    listed = archives.archive_files(spark, str(dataset)).collect()
    gone.unlink()
    found = archives.members(spark.createDataFrame(listed, "path string, bytes long, source_class string, source_item string"))
    assert {r.status for r in found.filter("path like '%item_002%'").collect()} == {"unreadable"}


def test_members_as_streams_are_the_same(spark, dataset, monkeypatch):
    columns = ["path", "member", "status", "row_no", "mesh_id_250m", "value"]
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    held = key(archives.read_archives(spark, str(dataset)))
    raw = zipfile.ZipFile(stores.opened(str(dataset / "02_drive_survey/item_001/2013.zip")))
    streamed = list(archives._rows(lambda: raw.open("a.csv")))
    assert streamed == list(archives._rows(lambda: io.BytesIO(raw.read("a.csv")))) and len(streamed[0][1]) == 500
    # Workers are processes of their own: the limit is lowered inside them.
    listed = archives.members(archives.archive_files(spark, str(dataset)))

    def small(batches):
        archives.HELD_BYTES, archives._SLICE = 0, 7
        yield from archives._read_members(batches)

    assert sorted(map(str, listed.mapInArrow(small, archives._SCHEMA).select(*columns).collect())) == held


def test_only_directories_and_wanted_archives_are_read(spark, dataset):
    assert archives.read_archives(spark, str(dataset), part_bytes=1).rdd.getNumPartitions() >= 6
    plan = archives.archive_files(spark, str(dataset))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan
    assert audit_of(archives.read_archives(spark, str(dataset), classes=["03_walk_survey"])) == [("item_002/2012", "a.csv", "ok", 500), ("item_002/2012", "b.csv", "malformed", 0)]
    assert {r[0] for r in audit_of(archives.read_archives(spark, str(dataset), items=["item_001"], years=[2013]))} == {"item_001/2013"}
    assert archives.read_archives(spark, str(dataset), years=[1999]).collect() == []

    class Counting(io.FileIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.read_bytes += len(out)
            return out

    big = dataset / "big.zip"
    with zipfile.ZipFile(big, "w") as z:
        z.writestr("a.csv", os.urandom(3_000_000))
    original = stores.opened
    try:
        stores.opened = lambda path: Counting(path)
        batch = pa.RecordBatch.from_pydict({"path": [str(big)], "bytes": [3_000_000]})
        found = next(archives._directories(iter([batch]))).to_pylist()
    finally:
        stores.opened = original
    assert found[0]["size"] == 3_000_000 and Counting.read_bytes < 70_000
    counts = {(r.source_class, r.source_item): (r.zips, r.csvs) for r in archives.inventory(spark, str(dataset), years=[2012]).collect()}
    assert counts == {("02_drive_survey", "item_001"): (1, 3), ("02_drive_survey", None): (1, 3), ("03_walk_survey", "item_002"): (1, 2), ("03_walk_survey", None): (1, 2), (None, None): (2, 5)}


def test_stores(tmp_path):
    path = str(tmp_path / "x" / "y")
    stores.put(path, b"abc")
    assert stores.size(f"file:{path}") == stores.size(f"file://{path}") == 3 and stores.opened(path).read() == b"abc"
    stores.remove(path)
    assert stores.size(path) == 0
