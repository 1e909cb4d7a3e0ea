"""Round trips to the state store do not grow with the rows of a session."""

from lodestream.streaming import session_cache


class Handle:
    """A state store in memory that counts what it is asked for."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*args):
            if name.startswith("get") and args:  # getValueState and its like
                return self
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value = None
            elif name == "registerTimer":
                self.timers.add(args[0])
            elif name == "deleteTimer":
                self.timers.discard(args[0])
            elif name == "listTimers":
                return iter(self.timers)

        return call

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_batch_of_a_session_is_a_few_calls():
    handle, cache = Handle(), session_cache.SessionCache()
    cache.init(handle)
    handle.now = 0
    rows = [{"micros": k * 1_000_000, "op": "cache", "record": f"r{k % 3}", "ttl_seconds": 10} for k in range(1, 2_001)]
    assert list(cache.handleInputRows((1,), iter(rows), handle)) == []
    assert handle.calls <= 4 and handle.timers == {1_000}
    handle.calls, handle.now = 0, 5_000_000
    handle.timers.clear()
    out = list(cache.handleExpiredTimer((1,), handle, None))
    assert handle.calls <= 3 and handle.value is None and not handle.timers
    assert {(r.record, r.cached_at, r.expires, r.live) for r in out} == {(f"r{k % 3}", k * 1_000_000, (k + 10) * 1_000_000, False) for k in (1998, 1999, 2000)}
