"""Memos of a Python task."""

import gc
from contextlib import contextmanager


@contextmanager
def for_task(make):
    """What ``make`` returns, for one task; it is closed when the task ends.

    Memos hold very many objects and few cycles, so the collector rests meanwhile instead of walking them
    again and again.  A worker that goes on to other tasks gives the memory back.
    """
    gc.disable()
    made = make()
    try:
        yield made
    finally:
        made.close()
        gc.enable()
        gc.collect()


class Memo(dict):
    """Results of a function, at most ``size`` of them; a full memo forgets what has not been asked for since
    it was last full."""

    def __init__(self, function, size):
        super().__init__()
        self.function, self.half, self.older = function, max(1, size // 2), {}

    def __missing__(self, key):
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value
