"""A stateful processor that sees each key's rows in event-time order.

Rows wait in state until the watermark has passed them, so rows that arrive out of order across
micro-batches are handled as if they had been sorted, and the result is that of the batch operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class OrderedProcessor(StatefulProcessor):
    """Subclasses give the waiting row's layout, the state layout and ``consume``."""

    row_schema: str
    state_schema: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = [
            row for frame in rows for row in frame[self.columns].itertuples(index=False, name=None)
        ]
        if arrived:
            self.waiting.appendList(arrived)
            earliest = min(self.millis(row) for row in arrived)
            self.handle.registerTimer(max(earliest, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(tuple(r) for r in rows if self.millis(r) <= watermark)
        later = [tuple(r) for r in rows if self.millis(r) > watermark]
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        state = tuple(self.state.get()) if self.state.exists() else None
        state, out = self.consume(key, state, due, watermark)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        wake = [self.millis(r) for r in later]
        until = self.expires(state)
        if until is not None:
            wake.append(until)
        if wake:
            self.handle.registerTimer(max(min(wake), watermark + 1))
        if out:
            yield pd.DataFrame(out)

    def millis(self, row) -> int:
        """Event time of a waiting row in milliseconds, rounded up."""
        return row[0]

    def consume(self, key, state: tuple | None, rows: list[tuple], watermark: int) -> tuple[Any, list[dict]]:
        """New state (None to drop it) and output rows."""
        raise NotImplementedError

    def expires(self, state: tuple | None) -> int | None:
        """When the state must be looked at even without new rows."""
        return None

    def close(self) -> None:
        pass
