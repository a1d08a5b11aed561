"""The line pipe gives every line once, over restarts and ranges, and the packets of the file source."""

import io

import pytest

from traceweave.sources.scan import DECODED_COLUMNS
from traceweave.streaming import live as L
from traceweave.streaming import pipe as P


def lines(n):
    return [f"line {i} {'é' * (i % 7)}" for i in range(n)]


def drained(stream, folder):
    L.append_log(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return sorted(r["value"] for r in stream.sparkSession.read.parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("range_bytes", [1, 17, 1 << 20])
def test_ranges_have_every_line_once(tmp_path, range_bytes):
    path = str(tmp_path / "spool")
    assert P.behind_last_line(path) == 0
    P.spool(io.BytesIO("\n".join(lines(40)).encode() + b"\n\n"), path)
    with open(path, "ab") as file:
        file.write(b"half a li")
    reader = P.LinePipeReader({"path": path, "rangebytes": str(range_bytes)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [x[0] for p in parts for x in reader.read(p)] == [*lines(40), ""]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, want = str(tmp_path / "spool"), lines(90)
    for upto in (30, 31, 90):
        with open(path, "ab") as file:
            begun = P.behind_last_line(path)
            held = len(open(path, "rb").read(begun).splitlines()) if begun else 0
            file.write("".join(f"{x}\n" for x in want[held:upto]).encode())
        assert drained(P.line_stream(spark, path, 64), str(tmp_path)) == sorted(want[:upto])


def test_packets_of_pipe_and_files_are_equal(spark, tmp_path):
    row = {name: "" for name in DECODED_COLUMNS}
    rows = ["\t".join(str(i) if "epoch" in name or "number" in name else "1" for name in row) for i in range(20)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("".join(f"{r}\n" for r in rows))
    got = []
    for name, stream in (
        ("pipe", P.piped_packets(spark, str(tmp_path / "files" / "a.txt"), 50)),
        ("file", L.packet_stream(spark, str(tmp_path / "files"))),
    ):
        L.append_log(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
        got.append(sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / name)).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == 20
