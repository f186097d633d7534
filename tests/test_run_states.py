"""Runs found by ordered lookups and pointer jumping against the state machine, line by line."""

import random

import pytest

from docsieve.operators import runs as R

NOTHING = ((None, None), (None, None))


def by_state(rows):
    """(log, line) -> parent, closes, status, top, open, one marker after another."""
    found, state, log = {}, NOTHING, None
    for log_id, line_no, kind, run_id, mode in sorted(rows, key=lambda r: r[:2]):
        state = state if log_id == log else NOTHING
        log = log_id
        state, (parent, closes, status) = R.advance(state, kind, run_id, mode, line_no)
        top, child = state[0][0], state[1][0]
        found[log_id, line_no] = (parent, closes, status, top, child if child is not None else top)
    return found


def tangled(seed, logs=40, most=60, ids=4):
    """Logs in which ids repeat, ends are missing, can't be read, or name runs that are long closed."""
    draw = random.Random(seed)
    rows = []
    for log_id in range(logs):
        line, batches, unread = 0, draw.choice((0, 0.05, 0.4)), draw.choice((0, 0.1, 0.4))
        for _ in range(draw.randrange(most)):
            line += draw.choice((1, 1, 2, 9))
            run_id = None if draw.random() < 0.03 else f"r{draw.randrange(ids)}"
            if draw.random() < 0.5:
                rows.append((log_id, line, "begin", run_id, "batch" if draw.random() < batches else "analyze"))
            else:
                rows.append((log_id, line, "end", None if draw.random() < unread else run_id, None))
    return rows


def chain(n):
    """A file that never ends inside a batch that does, then single runs: none is known to be open at once."""
    rows = [(1, 1, "begin", "b", "batch"), (1, 2, "begin", "lost", "analyze"), (1, 3, "begin", "f", "analyze"), (1, 4, "end", "f", None), (1, 5, "end", "b", None)]
    for k in range(n):
        rows += [(1, 10 + 2 * k, "begin", f"r{k}", "analyze"), (1, 11 + 2 * k, "end", f"r{k}", None)]
    return rows


def as_lines(spark, rows):
    def line(kind, run_id, mode):
        named = "" if run_id is None else f" id:{run_id}"
        return f"<{kind.upper()} ANALYSIS{named}{'' if mode is None else f' mode:{mode}'} timestamp:20240101_000000>"

    return spark.createDataFrame([(a, b, line(*rest)) for a, b, *rest in rows], "log_id long, line_no long, line string")


ROWS = [*tangled(1), *[(100 + a, *rest) for a, *rest in tangled(2, logs=25, ids=2)], *[(200 + a, *rest) for a, *rest in tangled(3, logs=8, most=200, ids=60)], *[(300 + a, *rest) for a, *rest in chain(70)]]


@pytest.mark.parametrize("settled, lines, keys, short", [(True, 4096, 256, 512), (True, 4, 3, 0), (False, 9, 1, 40)])
def test_runs_are_those_of_the_state_machine(spark, monkeypatch, settled, lines, keys, short):
    monkeypatch.setattr(R, "SHORT_LOG", short)
    monkeypatch.setattr(R, "LINES_PER_KEY", keys)
    monkeypatch.setattr(R, "_bucket", lambda n=None: R.F.floor(R.F.col("line_no") / (lines if n is None else lines * keys)))
    out = R.assign_markers(as_lines(spark, ROWS).repartition(3), settled).collect()
    found = {(r.log_id, r.line_no): (r.parent_line, r.closes_line, r.closes_status, r.top_line, r.open_line) for r in out}
    expected = by_state(ROWS)
    assert len(out) == len(ROWS)
    assert found == expected, [(k, found.get(k), v) for k, v in sorted(expected.items()) if found.get(k) != v][:5]


@pytest.mark.parametrize("short", [0, 512])
def test_no_python_worker_sees_a_marker(spark, monkeypatch, short):
    monkeypatch.setattr(R, "SHORT_LOG", short)
    plan = R.assign_markers(as_lines(spark, tangled(4, logs=2)))._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "Python" not in plan
