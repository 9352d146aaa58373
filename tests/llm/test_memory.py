"""What workers hold after a task."""

from bytequarry.llm import common


def test_memory_goes_back_after_each_task(monkeypatch):
    trims = []
    monkeypatch.setattr(common, "trim", lambda: trims.append(1))
    run = common.given_back(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2]))) == [2, 4] and len(trims) == 1
    stopped = run(iter([1, 2]))
    next(stopped)
    stopped.close()
    assert len(trims) == 2


def test_trim_runs_here():
    common.trim()
