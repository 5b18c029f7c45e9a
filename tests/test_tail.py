"""Lines of growing files."""

import random

from sparktrail.session import scratch_path
from sparktrail.sources import tail
from sparktrail.streaming import jobs, state


def _lines(spark, folder, root):
    tail.register(spark)
    state.drain(jobs.append(spark.readStream.format(tail.NAME).option("path", str(folder)).load(), root))
    return sorted((r.file, r.start, r.line) for r in state.outputs(spark, root).collect())


def test_pieces_truncation_and_restart(spark, tmp_path):
    root, folder = scratch_path(spark, "tail"), tmp_path / "trail"
    folder.mkdir()
    one, two = folder / "one.jsonl", folder / "two.jsonl"
    one.write_bytes('{"a":1}\n{"é'.encode()[:-1])  # ends within a character
    two.write_bytes(b"")
    (folder / ".hidden").write_bytes(b"no\n")
    assert _lines(spark, folder, root) == [("one.jsonl", 0, '{"a":1}')]
    with one.open("ab") as f:
        f.write('{"é'.encode()[-1:] + b'":2}\r\n\nlast')
    two.write_bytes(b"first\n")
    first = [("one.jsonl", 0, '{"a":1}'), ("one.jsonl", 8, '{"é":2}'), ("one.jsonl", 18, ""), ("two.jsonl", 0, "first")]
    assert _lines(spark, folder, root) == first
    assert _lines(spark, folder, root) == first  # nothing new
    two.write_bytes(b"a\n")  # shorter
    one.write_bytes(b"another beginning\n" + b"x" * 100 + b"\n")  # longer, but begins anew
    again = [("one.jsonl", 0, "another beginning"), ("one.jsonl", 18, "x" * 100), ("two.jsonl", 0, "a")]
    assert _lines(spark, folder, root) == sorted(first + again)


def test_ranges(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    lines = ["".join(rng.choices("abc é", k=rng.choice((0, 1, 5, 300)))) for _ in range(400)]
    folder = tmp_path / "trail"
    folder.mkdir()
    payload = "".join(f"{line}\n" for line in lines).encode()
    (folder / "f").write_bytes(payload)
    want, at = [], 0
    for line in lines:
        want.append(("f", at, line))
        at += len(line.encode()) + 1
    monkeypatch.setattr(tail, "RANGE", 97)
    reader = tail.LineReader({"path": str(folder)})
    got, start = [], reader.initialOffset()
    for size in (0, 1, 500, 501, 7000, 7000, len(payload)):
        (folder / "f").write_bytes(payload[:size])
        end = reader.latestOffset()
        got += [row for p in reader.partitions(start, end) for row in reader.read(p)]
        start = end
    assert got == want
    assert _lines(spark, folder, scratch_path(spark, "tail")) == sorted(want)
