"""Keyed processors over a stand-in for their state, and their bounds."""

import random

import pytest

from telemill.streaming import keyed


class Value:
    def __init__(self):
        self.x = None

    def exists(self):
        return self.x is not None

    def get(self):
        return self.x

    def update(self, x):
        self.x = x

    def clear(self):
        self.x = None


class Rows(Value):
    def put(self, x):
        self.x = list(x)

    def appendList(self, x):  # noqa: N802
        self.x = [*(self.x or []), *x]

    def get(self):
        return iter(self.x)


class Handle:
    def __init__(self):
        self.timers, self.state = set(), {}

    def getValueState(self, name, schema):  # noqa: N802
        return self.state.setdefault(name, Value())

    def getListState(self, name, schema):  # noqa: N802
        return self.state.setdefault(name, Rows())

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)


class Times:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.t

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.t


class Driven:
    """Runs batches of rows of one key, and then the timers that the watermark has passed, as a micro-batch does."""

    def __init__(self, processor):
        self.p, self.h = processor, Handle()
        processor.init(self.h)

    def batch(self, rows, before, after):
        out = list(self.p.handleInputRows(("k",), iter(rows), Times(before))) if rows else []
        for t in sorted(t for t in self.h.timers if t < after):
            self.h.timers.discard(t)
            out += self.p.handleExpiredTimer(("k",), Times(after), Times(t))
        return [r.asDict() for r in out]


def go(kind, at, status=None):
    return {"kind": kind, "at": at, "status": status}


def test_lifecycle():
    d = Driven(keyed.Lifecycle(10))
    assert d.batch([go("start", 5.0), go("start", 4.0)], 0, 4000) == []
    assert d.h.timers == {14000}
    assert d.batch([go("finish", 8.0, 500), go("finish", 7.0, 200)], 4000, 20000) == [{"id": "k", "state": "error", "started": 4.0, "finished": 8.0, "status": 500}]
    assert d.h.timers == set() and not d.h.state["open"].exists()
    d.batch([go("start", 30.0)], 20000, 20000)
    assert d.batch([], 0, 41000) == [{"id": "k", "state": "interrupted", "started": 30.0, "finished": None, "status": None}]
    assert d.batch([go("finish", 50.0, None)], 41000, 50000)[0]["state"] == "completed"
    assert not d.h.state["open"].exists() and d.h.timers == set()


@pytest.mark.parametrize("seed", range(8))
def test_capture_holds_no_more_than_the_limit(seed):
    rng = random.Random(seed)
    lines = [(i, rng.choice(["", "é", "abc", "a longer line"]) * rng.randint(0, 4)) for i in range(60)]
    rng.shuffle(lines)
    d, last, many = Driven(keyed.Capture(50)), None, lines[:]
    while many:
        part, many = many[:7], many[7:]
        for r in d.p.handleInputRows(("k",), iter({"seq": s, "line": x} for s, x in part), Times(0)):
            last = r
        assert sum(len(x) for _, x in d.h.state["held"].get()) <= 50
    whole = "".join(x + "\n" for _, x in sorted(lines)).encode()
    assert (last["response"], last["truncated"]) == (whole[:50].decode("utf-8", "replace"), len(whole) > 50)


def sample(us, x):
    return {"us": us, "x": x}


def test_steps_are_in_order_over_batches():
    d = Driven(keyed.Steps(("k",)))
    assert d.batch([sample(3000, 4.0), sample(1000, 2.0)], 0, 2) == [{"k": "k", "ts": 1000, "before": None, "value": 2.0, "delta": None}]
    assert [x[0] for x in d.h.state["waiting"].get()] == [3000]
    out = d.batch([sample(2500, 9.0), sample(9000, 1.0)], 2, 5)
    assert [(r["ts"], r["before"], r["delta"]) for r in out] == [(2500, 1000, 7.0), (3000, 2500, 4.0)]  # a fall counts with its value
    out = d.batch([], 5, 20)
    assert [(r["ts"], r["before"], r["delta"]) for r in out] == [(9000, 3000, 1.0)]
    assert not d.h.state["waiting"].exists() and d.h.timers == set()


def brute_alerts(rows, hold, mark):
    out, since, until, n = [], None, None, 0
    for us, x in sorted(rows):
        if us > mark:
            break
        if x:
            if since is None:
                since, n = us, 0
                out.append(("pending", us, us, None, None))
            until, n = us, n + 1
        elif since is not None:
            if us - since >= hold:
                out.append(("firing", since + hold, since, None, None))
            out.append(("resolved" if us - since >= hold else "inactive", us, since, until, n))
            since = None
    if since is not None and since + hold < mark:
        out.append(("firing", since + hold, since, None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(20))
def test_alerts_in_any_batches(seed):
    rng = random.Random(seed)
    rows = [(1000 * t, rng.random() < 0.7) for t in rng.sample(range(1000), 80)]
    d, out, before = Driven(keyed.Alert(("k",), 0.03)), [], 0
    for lo in range(0, 1000, 100):
        part = [sample(*r) for r in rows if lo <= r[0] // 1000 + rng.randint(0, 0) < lo + 100]
        rng.shuffle(part)
        out += d.batch(part, before, before := max(before, lo + rng.randint(0, 99) - 40))
    out += d.batch([], before, 2000)
    got = sorted(((r["kind"], r["at"], r["since"], r["until"], r["samples"]) for r in out), key=str)
    assert got == brute_alerts(rows, 30_000, 2_000_000)


@pytest.mark.parametrize("seed", range(10))
def test_lifecycles_of_a_group_are_those_of_its_ids(seed):
    """One call and one state for all ids of a group; the rows are those of a processor for each id."""
    import pandas as pd

    rng = random.Random(seed)
    group, alone, before, want, got = keyed.Lifecycles(10), {k: Driven(keyed.Lifecycle(10)) for k in "abcdef"}, 0, [], []
    h, plain = Handle(), lambda r: tuple(None if x is None or x != x else x for x in (r[c] for c in ("state", "started", "finished", "status")))
    group.init(h)
    for n in range(12):
        rows = [(rng.choice("abcdef"), *((k := rng.choice(["start", "start", "finish"])), n * 3 + rng.randint(0, 5) + 0.5, rng.choice([200, 500]) if k == "finish" else None)) for _ in range(rng.randint(0, 8))]
        after = before + rng.randint(0, 6000)
        for k, d in alone.items():
            want += [(n, k, *plain(r)) for r in d.batch([go(*r[1:]) for r in rows if r[0] == k], before, after)]
        frames = list(group.handleInputRows((0,), iter([pd.DataFrame(rows[:3], columns=["id", "kind", "at", "status"]), pd.DataFrame(rows[3:], columns=["id", "kind", "at", "status"])]), Times(before))) if rows else []
        for t in sorted(t for t in h.timers if t < after):
            h.timers.discard(t)
            frames += group.handleExpiredTimer((0,), Times(after), Times(t))
        assert len(h.timers) <= 1 and min(h.timers, default=after) >= after
        got += [(n, r["id"], *plain(r)) for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
        before = after
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key) and want
