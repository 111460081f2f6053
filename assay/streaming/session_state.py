"""The guided session as keyed state: milestones, and the events that may still become one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assay.operators.sessions import STEP_EVENTS

STEP_SCHEMA = "step int, at1 long, at2 long, at3 long"


def thinned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fewer rows before the exchange: of a session's first events the earliest, of events of other kinds one as a sign of life."""
    for frame in frames:
        later = frame[frame.kind.isin(STEP_EVENTS[1:])]
        opening = frame[frame.kind == STEP_EVENTS[0]].groupby("session", sort=False, dropna=False, as_index=False).pos.min()
        others = frame[~frame.kind.isin(STEP_EVENTS)].drop_duplicates("session")
        yield pd.concat([later, opening.assign(kind=STEP_EVENTS[0]), others])[list(frame.columns)]


class SessionSteps(StatefulProcessor):
    """Milestone i + 1 is the first event of kind i after milestone i; events come in any order.

    Milestones only move to earlier places. So of the events after the milestone before theirs the earliest is enough, and
    is the milestone; those at or before it wait in a list, which grows by appending and is only rewritten when the
    milestone before moves and lets some of them go on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "at1 long, at2 long, at3 long")
        self.waiting = [handle.getListState(f"waiting{i}", "pos long") for i in range(1, len(STEP_EVENTS))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One call to the store, none more: its answers take longer than the work on a session.
        known = self.marks.get()
        marks = list(known) if known is not None else [None] * len(STEP_EVENTS)
        old = tuple(marks)
        found: list[list[np.ndarray]] = [[] for _ in STEP_EVENTS]
        for frame in rows:
            kinds, pos = frame["kind"].to_numpy(), frame["pos"].to_numpy()
            known_pos = ~pd.isna(pos)
            for i, kind in enumerate(STEP_EVENTS):
                found[i].append(pos[(kinds == kind) & known_pos].astype(np.int64))
        new = [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]
        before, moved = None, False  # the milestone before, and whether it is a new one
        for i in range(len(STEP_EVENTS)):
            mark = marks[i]
            if i == 0:
                after, early = new[0], None
            else:
                # Nothing counts until the milestone before is there.
                split = len(new[i]) if before is None else int(np.searchsorted(new[i], before, "right"))
                early, after = new[i][:split], new[i][split:]
                if moved and self.waiting[i - 1].exists():
                    held = np.array([p for (p,) in self.waiting[i - 1].get()], np.int64)
                    after = np.concatenate([after, held[held > before]])
                    left = np.unique(np.concatenate([early, held[held <= before]]))
                    if len(left):
                        self.waiting[i - 1].put([(int(p),) for p in left])
                    else:
                        self.waiting[i - 1].clear()
                elif len(early):
                    self.waiting[i - 1].appendList([(int(p),) for p in early])
            best = int(after.min()) if len(after) else None
            moved = best is not None and (mark is None or best < mark)
            if moved:
                marks[i] = best
            before = marks[i]
        if known is None or old != tuple(marks):
            self.marks.update(tuple(marks))
        step = sum(m is not None for m in marks)
        yield pd.DataFrame([(key[0], step, *marks)], columns=["session", "step", "at1", "at2", "at3"], dtype=object)

    def close(self) -> None:
        pass
