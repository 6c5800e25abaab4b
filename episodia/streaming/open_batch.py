"""The state of one batch of a run. It travels to the tasks by value, so that workers need nothing of this package."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSED = "batch_id long, n long, n_missing long, batch_score decimal(28,12)"


class OpenBatch(StatefulProcessor):
    """One batch of a run: the ids that have come, until all have or the batch is overdue.

    A timer stands ``patience`` after the first output's time. A full batch is handed on at once; it then remembers only
    that it is closed. When the watermark passes the timer, an open batch is handed on with its missing rows, which score
    nothing, and the state goes in either case. So there is state for batches under way, and no longer than that.
    """

    def __init__(self, patience: int):
        self.patience = patience * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "ids array<string>, n long, total decimal(28,12), closed boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.state.exists()
        ids, n, total, closed = self.state.get() if known else ([], None, Decimal(0), False)
        if closed:
            return
        seen, fresh = set(ids), {}
        for row in rows:
            n = row["n"]
            if row["id"] not in seen:  # the earliest output of an id counts, of equal times the one that scores least
                way = (row["at"], row["score"])
                fresh[row["id"]] = min(fresh.get(row["id"], way), way)
        total += sum(score for _, score in fresh.values())
        seen.update(fresh)
        if not known:
            self.handle.registerTimer(min(at for at, _ in fresh.values()) + self.patience)
        full = len(seen) >= n
        self.state.update(([] if full else sorted(seen), n, total, full))
        if full:
            yield Row(batch_id=key[0], n=n, n_missing=0, batch_score=total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            ids, n, total, closed = self.state.get()
            self.state.clear()
            if not closed:
                yield Row(batch_id=key[0], n=n, n_missing=n - len(ids), batch_score=total)

    def close(self) -> None:
        pass


register_pickle_by_value(sys.modules[__name__])
