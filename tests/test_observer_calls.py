"""How often the observer speaks to its store: each call is a message to another process."""

import pandas as pd

from sparkloom.streaming.observer import Limits, Observer


class Store:
    """A handle and its states, in memory; counts calls."""

    def __init__(self):
        self.calls, self.timers, self.value = 0, set(), None

    def getListState(self, name, schema):
        return self

    getValueState = getListState

    def called(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self.called(self.value is not None)

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.called()
        self.value = value

    def put(self, rows):
        self.called()

    def clear(self):
        self.called()
        self.value = None

    def listTimers(self):
        return self.called(list(self.timers))

    def deleteTimer(self, at):
        self.called(self.timers.remove(at))

    def registerTimer(self, at):
        self.called(self.timers.add(at))


def batch(*us):
    return iter([pd.DataFrame({"us": list(us), "event_id": range(len(us)), "kind": ["view", "click"] * (len(us) // 2), "target": [None] * len(us)})])


def test_few_calls_a_user():
    store, observer = Store(), Observer(Limits(quiet_us=1_000_000))
    observer.init(store)
    assert list(observer.handleInputRows((7,), batch(30, 10, 20, 40), None)) == [] and store.calls <= 4  # new, nothing ended: no frame
    assert store.timers == {1001}
    store.calls = 0
    assert list(observer.handleInputRows((7,), batch(600_000, 700_000), None)) == [] and store.calls <= 6  # goes on, with one timer
    assert store.timers == {1701}
    store.calls = 0
    (out,) = observer.handleExpiredTimer((7,), None, None)
    assert store.calls <= 3 and set(out["steps"]) == {6} and "config_discovery" in set(out["pattern"]) and store.value is None
