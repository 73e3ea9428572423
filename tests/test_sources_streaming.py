"""Sources, sinks, list checks and streams."""

import datetime
import hashlib
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veilwork.operators import reports
from veilwork.operators.decide import Policy
from veilwork.plans import flagship
from veilwork.sources import sinks
from veilwork.sources import tables as S
from veilwork.streaming import jobs


def test_area_code_file_and_list_files(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("NPA_ID,LOCATION,COUNTRY,USE,IN_SERVICE\n212,NY,US,G,Y\n213,CA,US,G,N\n416,ON,CA,G,Y\n800,US,US,N,Y\n")
    rows = S.area_code_list(S.read_area_code_file(spark, str(tmp_path / "codes.csv"))).collect()
    assert [r.record for r in rows] == ["212 NY"]
    files = tmp_path / "lists"
    files.mkdir()
    good, dup = b"AVE\nST\n", b"ST\nST\n"
    (files / "good.txt").write_bytes(good)
    (files / "dup.txt").write_bytes(dup)
    (files / "open.txt").write_bytes(b"ST")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame(
        [(n, "1", "https://example.org", "2024-01-01", c, sha(b)) for n, c, b in [("good", 2, good), ("dup", 2, dup), ("open", 1, b"ST")]],
        "list_id string, version string, source_url string, retrieved_on string, record_count int, sha256 string",
    )
    got = {r.list_id: r.state for r in S.validate_lists(S.read_list_files(spark, str(files)), manifest).collect()}
    assert got == {"good": S.VALID, "dup": S.LIST_STATES["records"], "open": S.LIST_STATES["records"]}


def test_html_table_rows(spark):
    page = "<table><tr><td>x</td></tr></table><table><tr><th>Name</th><th>Code</th></tr><tr><td>A &amp; <b>B</b></td><td>AB</td></tr></table>"
    rows = S.html_table_rows(spark.createDataFrame([(1, page)], "id int, html string"), "id", "html", 1).collect()
    assert [r.cells for r in rows] == [["Name", "Code"], ["A & B", "AB"]]
    odd = "<TABLE><TR><TD class='x'>&amp;lt; &nbsp;y &copy;</TD><td></td></TR></TABLE>"
    rows = S.html_table_rows(spark.createDataFrame([(1, odd), (2, None), (3, "")], "id int, html string"), "id", "html", 0).collect()
    assert [(r.id, r.cells) for r in rows] == [(1, ["&lt; y &copy;", ""])]


def test_html_tables_nested_and_unclosed(spark):
    pages = ["<table><tr><td>a<table><td>in<tr><td>second</table> tail<td>b</table></table></td><table><tr><tr><td>c",
             "no table </table><td>x</td>", None, "<!-- <table><td>no --><table><th>h</th>between<th>i<script>'<td>'</script></table>" * 2,
             "<table>" * 3000 + "<td>deep"]
    got = sorted((r.id, r.table, r.row, r.cells) for r in S.html_tables(spark.createDataFrame(list(enumerate(pages)), "id int, html string"), "id", "html").collect())
    assert got == [(0, 0, 0, ["a tail", "b"]), (0, 1, 0, ["in"]), (0, 1, 1, ["second"]), (0, 2, 1, ["c"]), (3, 0, 0, ["h", "i"]), (3, 1, 0, ["h", "i"]),
                   (4, 2999, 0, ["deep"])]


def test_required_detectors(spark):
    ready = spark.createDataFrame([("us.ssn", "Ready"), ("us.phone", "NotProvided")], "detector_id string, state string")
    S.require_detectors(["us.ssn"], ready)
    with pytest.raises(ValueError, match="us.phone"):
        S.require_detectors(["us.ssn", "us.phone"], ready)


def test_sink_writes_a_batch_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    sink = sinks.BatchSink(spark, str(tmp_path / "out"), "doc_id long, text string", ["doc_id"], buckets=8)
    assert sink.rows().count() == 0
    sink.write(df, 0)
    sink.write(df, 0)
    sink.stage(df, 1, "killed")  # an attempt that never came to its commit
    assert sorted(r.doc_id for r in sink.rows().collect()) == list(range(50))
    sink.write(df.where("doc_id < 3"), 1)
    sink.write(df.where("doc_id < 2"), 1)
    again = sinks.BatchSink(spark, str(tmp_path / "out"), "doc_id long, text string", ["doc_id"], buckets=8)
    assert again.rows().count() == 52 and again.rows(before=1).count() == 50
    some = again.rows(of=df.where("doc_id = 7"))
    assert 7 in {r.doc_id for r in some.collect()}
    assert some.count() < 52  # other buckets are not read
    sink.write(df.limit(0), 0)
    assert sink.rows().count() == 2
    with pytest.raises(ValueError, match="text"):
        sinks.write_events(df, sink, 2)


def test_a_value_keeps_its_number_across_turns(spark):
    turns = spark.createDataFrame(
        [(1, 0, "a@b.co"), (1, 1, "c@d.co"), (1, 2000, "a@b.co e@f.co"), (2, 0, "e@f.co")], "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): r.redacted for r in flagship.redact_conversations(turns, Policy()).collect()}
    assert got == {(1, 0): "[이메일1]", (1, 1): "[이메일2]", (1, 2000): "[이메일1] [이메일3]", (2, 0): "[이메일1]"}


def _stream(spark, tmp_path, df, name):
    src = str(tmp_path / f"{name}-in")
    df.coalesce(1).write.parquet(src)  # one file: arrival order is row order
    return S.stream_source(spark, src, df.schema, 1)



def _files(spark, tmp_path, name, *parts):
    """A stream that gets each of these tables as one file, one a micro-batch."""
    src = str(tmp_path / f"{name}-in")
    for df in parts:
        df.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are taken by their time
    return S.stream_source(spark, src, parts[0].schema, 1)


def _run(spark, df, name, seconds=180):
    with jobs.state_store(spark):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(seconds)
    return spark.table(name).collect()


def test_revision_stream(spark, tmp_path):
    changes = [spark.createDataFrame(rows, "doc_id long, seq long, text string") for rows in (
        [(1, 1, "a"), (1, 0, "a"), (2, 0, "z")], [(1, 2, "b"), (1, 3, "a"), (2, 1, None)])]
    got = sorted((r.doc_id, r.seq, r.changed, r.rev) for r in _run(spark, jobs.revision_stream(_files(spark, tmp_path, "rev", *changes)), "rev_out"))
    whole = changes[0].union(changes[1])
    want = sorted((r.doc_id, r.seq, r.changed, r.rev) for r in reports.changed_revisions(whole, "doc_id", "seq").collect())
    assert got == want and got[:4] == [(1, 0, True, 1), (1, 1, False, 1), (1, 2, True, 2), (1, 3, True, 3)]


def test_no_grant_passes_twice(spark, tmp_path):
    columns = "doc_id long, seq long, rev long, detector_id string, canonical string, risk int, n int"
    first = [(1, 0, 1, "kr.phone", "x", None, 2), (1, 1, 1, "kr.phone", "x", 1, 0), (1, 2, 1, "kr.phone", "y", 1, 0), (2, 0, 1, "kr.phone", "x", 1, 0),
             (3, 0, 1, "kr.phone", "x", 1, 1), (4, 0, 2, "d", "v", 1, 1)]
    second = [(1, 3, 1, "kr.phone", "x", 3, 0), (1, 4, 1, "kr.phone", "x", 1, None), (1, 5, 1, "kr.phone", "x", 1, 0), (3, 1, 2, "kr.phone", "x", 1, 0),
              (3, 2, 1, "kr.phone", "x", 1, 0), (4, 1, 1, "d", "v", 1, 0), (4, 2, 2, "d", "v", 1, 0)]
    events = _files(spark, tmp_path, "grant", *(spark.createDataFrame(x, columns) for x in (first, second)))
    got = {(r.doc_id, r.seq): r.granted for r in _run(spark, jobs.grant_stream(events), "grant_out")}
    assert got == {(1, 1): True, (1, 2): False, (2, 0): False, (1, 3): False, (1, 4): True, (1, 5): False,
                   (3, 1): False,  # a later revision: the pass of the first is void
                   (3, 2): False, (4, 1): False, (4, 2): True}


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_status_stream_has_a_deadline(spark, tmp_path):
    columns = "source string, seq long, attempt_id long, terminal string, ts timestamp"
    first = [("a", 0, 1, None, _at(0)), ("a", 1, 0, "Success", _at(20)), ("a", 2, 1, "what", _at(25)), ("b", 0, 1, None, _at(0)), ("b", 1, 1, "Success", _at(29))]
    second = [("a", 3, 0, None, _at(40)), ("a", 4, 2, "UnauthorizedTarget", _at(50)), ("c", 0, 7, None, _at(60))]
    third = [("a", 5, 3, None, _at(300)), ("a", 6, 3, "NoActionRequired", _at(301))]
    events = _files(spark, tmp_path, "status", *(spark.createDataFrame(x, columns) for x in (first, second, third)))
    got = _run(spark, jobs.status_stream(events.withWatermark("ts", "5 seconds"), ts="ts"), "status_out", 300)
    by = lambda s: sorted((r.seq, r.attempt_id, r.status, r.warn) for r in got if r.source == s)
    # events of an older attempt at 20 and 40 and an unknown name at 25 do not move the deadline at 30
    assert by("a") == [(-1, 1, "Limited", True), (0, 1, "Scanning", False), (4, 2, "Limited", False), (5, 3, "Scanning", False), (6, 3, "Ready", False)]
    assert by("b") == [(0, 1, "Scanning", False), (1, 1, "Verified", False)]
    assert by("c") == [(-1, 7, "Limited", True), (0, 7, "Scanning", False)]


def test_status_stream_by_the_clock(spark, tmp_path):
    names = [None, "Success", None, "WriteRejected", None, "UnauthorizedTarget", "ProcessingException", None, "NoActionRequired", None]
    rows = [("s", i, i // 2 if i != 7 else 0, n) for i, n in enumerate(names)]
    events = spark.createDataFrame(rows, "source string, seq long, attempt_id long, terminal string")
    history = reports.status_history(events)
    with jobs.state_store(spark):
        q = jobs.status_stream(_stream(spark, tmp_path, events, "clock"), timeout_ms=4000).writeStream.format("memory").queryName(
            "clock_out").outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(90):
        if spark.table("clock_out").where("seq = -1").count():
            break
        time.sleep(1)
    q.stop()
    got = spark.table("clock_out").collect()
    assert sorted((r.seq, r.status) for r in got if r.seq >= 0) == sorted((r.seq, r.status) for r in history.collect())
    assert [(r.attempt_id, r.status, r.warn) for r in got if r.seq < 0] == [(4, "Limited", True)]
    assert sorted(r.seq for r in reports.warning_notify(history).collect()) == sorted(r.seq for r in got if r.warn and r.seq >= 0)


def test_stream_scan_skips_own_writes_and_replays(spark, tmp_path):
    columns = "doc_id long, seq long, text string"
    parts = [spark.createDataFrame(x, columns) for x in ([(1, 0, "old"), (1, 1, "call 010-1234-5678"), (2, 0, "api_key=Zx9Qw2Lm7Rt4")],
                                                         [(1, 2, "call [전화번호1]"), (3, 0, "mail a@b.co")])]
    stream, out, checkpoint = _files(spark, tmp_path, "scan", *parts), str(tmp_path / "scan-out"), str(tmp_path / "cp")
    told = []

    def fail(number):
        told.append(number)
        if told.count(1) == 1 and number == 1:
            raise RuntimeError("lost after its rows were committed")

    with pytest.raises(StreamingQueryException):
        jobs.stream_scan(stream, out, checkpoint, once=True, written=fail).awaitTermination(180)
    jobs.stream_scan(stream, out, checkpoint, once=True, written=told.append).awaitTermination(180)
    assert told == [0, 1, 1]
    rows = jobs.scan_sink(spark, out).rows().collect()
    assert sorted((r.doc_id, r.seq, r.text, r.batch) for r in rows) == [(1, 1, "call [전화번호1]", 0), (3, 0, "mail [이메일1]", 1)]
