"""Logs are worked by ranges of lines: what a range ends with must reach the later ones."""

import random

import pytest

from quire.operators import logs

LINES = (
    "Predict: {0}%|#| {0}/9 [x]", "OCR-det: 5%|#| 1/{0} [x]", "2026-04-25 1{0}:00:00 GET /health 200 OK", "2026-04-25 1{0}:30:00 page_count=4{0}", "Hybrid processing window 1/2: pages 1-3/5{0}",
    "Using onnx", "no signal 2026-04-25 23:00:00", "  ", "Error: {0}", "killed", "100%| but no progress",
)


def _lines(spark):
    rng = random.Random(5)
    rows = [(source, seq, rng.choice(LINES).format(rng.randrange(1, 9))) for source, n in (("a", 60), (None, 25), ("b", 1)) for seq in rng.sample(range(400), n)]
    return rows, spark.createDataFrame([*rows, ("quiet", 1, None), ("quiet", 2, "")], "source string, seq long, line string")


@pytest.mark.parametrize("width", [1, 7, 90, 10**9])
def test_ranges_change_nothing(spark, monkeypatch, width):
    monkeypatch.setattr(logs, "RANGE", width)
    rows, lines = _lines(spark)
    got = {(r.source, r.seq): r for r in logs.classified(lines).collect()}
    own = {(r.source, r.seq): r for r in logs.marked(lines).collect()}
    assert set(got) == set(own) and not any(source == "quiet" for source, _ in got)
    changes, counts = set(), {}
    for source in ("a", None, "b"):
        context = phase = None
        mine = [own[key] for key in sorted((s, q) for s, q, _ in rows if s == source) if key in own] if source else [own[None, q] for q in sorted(q for s, q, _ in rows if s is None) if (None, q) in own]
        for line in mine:
            context = line.stamp or context
            assert got[source, line.seq].context == context
            if line.signal == "progress":
                if phase not in (None, line.phase):
                    changes.add((source, line.seq, line.phase))
                phase = line.phase
        last = [x for x in mine if x.signal == "progress"][-1:]
        counts[source] = (len([x for x in mine if x.signal == "progress"]), len([c for c in changes if c[0] == source]), *((last[0].phase, last[0].total) if last else (None, None)))
    assert {(r.source, r.seq, r.phase) for r in logs.phase_changes(logs.marked(lines)).collect()} == changes and len(changes) > 3
    got = {r.source: (r.n_progress, r.n_changes, r.phase, r.total) for r in logs.summary(logs.marked(lines)).collect()}
    assert got == {source: n for source, n in counts.items() if any(key[0] == source for key in own)}
