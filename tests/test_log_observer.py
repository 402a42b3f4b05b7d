"""Observing a growing log: wherever it is cut, the parts give what the whole gives."""

import random

import pytest

from quire import sources
from quire.operators import logs
from quire.sources import tail
from quire.streaming import poll, polled
from quire.streaming.logs import observer, state

LINES = (
    "Predict: {0}%|#| {0}/9 [x]", "OCR-det: 5%|#| 1/{0} [x]", "2026-04-25 1{0}:00:00 GET /health 200 OK", "2026-04-25 1{0}:30:00 page_count=4{0}", "Hybrid processing window 1/2: pages 1-3/5{0}",
    "Using onnx", "no signal 2026-04-25 23:00:00", "  ", "Error: {0}", "killed", "page_count=7{0}",
)
N = 60


@pytest.mark.parametrize("since", [None, "2026-04-25 13:30:00"])
@pytest.mark.parametrize("width", [5, 10**9])
def test_a_log_cut_anywhere(spark, monkeypatch, since, width):
    monkeypatch.setattr(logs, "RANGE", width)
    rng = random.Random(10)
    text = [rng.choice(LINES).format(rng.randrange(1, 9)) for _ in range(N)]
    # source k is the log cut before its line k
    rows = [(k, i, line) for k in range(N + 1) for i, line in enumerate(text)]
    lines = spark.createDataFrame(rows, "source long, seq long, line string")
    nothing = spark.createDataFrame([], f"source long, {logs.CARRIED}")
    _, whole = logs.observed(lines, nothing, since)
    first, left = logs.observed(lines.where("seq < source"), nothing, since)
    left = spark.createDataFrame(left.collect(), left.schema)
    then, after = logs.observed(lines.where("seq >= source"), left, since)
    want = {r.source: r for r in whole.collect()}
    got = {r.source: r for r in after.collect()}
    assert len({tuple(r)[1:] for r in want.values()}) == 1
    if since is None:  # an older context does not begin a later observation of the same task
        assert {tuple(r) for r in got.values()} == {tuple(r) for r in want.values()}
    counts = ("n_progress", "n_changes", "n_business", "n_noise", "n_error", "n_error_signal")
    sums = {}
    for r in first.collect() + then.collect():
        sums[r.source] = [a + r[c] for a, c in zip(sums.get(r.source, [0] * len(counts)), counts, strict=True)]
    total = {r.source: [r[c] for c in counts] for r in logs.summary(logs.segment(logs.classified(lines), since) if since else logs.classified(lines)).collect()}
    assert sums == total and sums[3][1] > 1
    context = {(r.source, r.seq): r.context for r in logs.classified(lines).collect()}
    again = {(r.source, r.seq): r.context for r in logs.classified(lines.where("seq >= source"), left).collect()}
    assert since or all(context[k] == c for k, c in again.items())
    changes = {(r.source, r.seq) for r in logs.phase_changes(logs.marked(lines)).where("seq >= source").collect()}
    assert since or {(r.source, r.seq) for r in logs.phase_changes(logs.marked(lines.where("seq >= source")), left).collect()} == changes


def test_tail_reads_the_end_only(spark, tmp_path):
    big = tmp_path / "big.log"
    with big.open("wb") as f:  # more than two gigabytes, without holding them
        f.truncate(3 << 30)
        f.seek(0, 2)
        f.write("é".encode() * 50 + b"end")
    (tmp_path / "small.log").write_text("ab\ncd", encoding="utf-8")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / ".hidden").write_text("x")
    got = {r.path.rsplit("/")[-1]: (r.size, r.text) for r in sources.log_tail(spark, str(tmp_path), 10).collect()}
    assert got == {"big.log": ((3 << 30) + 103, "é" * 3 + "end"), "small.log": (5, "ab\ncd"), "empty.log": (0, "")}
    assert sources.log_tail(spark, str(tmp_path / "*mall.log")).count() == 1

    class Opened:
        asked = 0

        def open_input_file(self, file):
            self.file = open(file, "rb")
            return self

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, n):
            self.file.seek(n)

        def read(self, n):
            Opened.asked += n
            return self.file.read(n)

    assert tail.tail(Opened(), str(big), big.stat().st_size, 8192)[-3:] == b"end" and Opened.asked == 8192


def test_lines_of_parts_are_read_once(monkeypatch, tmp_path):
    """Whatever the parts of a file, each line is read by the part that it begins in."""
    rng = random.Random(2)
    text = "".join(rng.choice("ab\né\n") * rng.randrange(40) + "\n" for _ in range(60))
    file = tmp_path / "x.log"
    file.write_text(text + "not whole", encoding="utf-8")
    for part, block in ((7, 5), (50, 64), (1, 3), (1 << 20, 1 << 16)):
        monkeypatch.setattr(tail, "PART_BYTES", part)
        monkeypatch.setattr(tail, "BLOCK", block)
        reader = tail._LineReader(str(tmp_path))
        end = reader.latestOffset()
        got = [row for p in reader.partitions(reader.initialOffset(), end) for row in reader.read(p)]
        assert [r[2] for r in got] == text.split("\n")[:-1] and [r[1] for r in got] == sorted({r[1] for r in got})


def test_a_stream_of_lines_goes_on(spark, tmp_path):
    log, folder = tmp_path / "logs", str(tmp_path / "loop")
    log.mkdir()
    steps = [{"a": "Layout: 1%|#| 1/5 [x]\nLay", "b": "2026-04-25 10:00:00 page_count=9\n"}, {"a": "out: 50%|#| 2/5 [x]\nOCR: 1%|#| 1/2 [x]\n", "c": "killed\n"}, {"a": "Hybrid processing window 1/2: pages 1-3/8\n", "b": "Layout: 1%|#| 1/9 [x]\n"}]
    for step in steps:
        for name, text in step.items():
            with (log / name).open("a") as f:
                f.write(text)
        poll(sources.log_lines(spark, str(log)), observer(folder), folder).awaitTermination()
    left = {r.source.rsplit("/")[-1]: r for r in state(spark, folder, "string").collect()}
    assert {k: (r.phase, r.context, r.page_total, r.total_pages) for k, r in left.items()} == {"a": ("OCR", None, 8, 8), "b": ("Layout", "2026-04-25 10:00:00", None, 9), "c": (None, None, None, None)}
    kept = polled(spark, folder, "source string, n_progress long, n_changes long, batch int").collect()
    assert sum(r.n_progress for r in kept) == 4 and sum(r.n_changes for r in kept) == 1
