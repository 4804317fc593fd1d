"""What a running layout offers to a front end: actions and number series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Payload:
    """What an action is called with."""

    world_x: float = 0.0
    world_y: float = 0.0
    delta_time: float = 0.0
    iarg: int = 0
    darg: float = 0.0


class Session:
    """Named actions and append-only series."""

    def __init__(self) -> None:
        self._actions: dict[str, Callable[[Payload], Any]] = {}
        self._series: dict[str, list[float]] = {}
        self._kinds: dict[str, str] = {}
        self._revisions: dict[str, int] = {}

    # ---- actions ----

    def action(self, name: str, call: Callable[[Payload], Any]) -> None:
        """Registers call; the same name replaces in place."""
        if not name:
            raise ValueError("an action has a name")
        self._actions[name] = call

    def remove_action(self, name: str) -> int:
        """0, or -1 if unknown; the last action takes the place of the removed one."""
        if name not in self._actions:
            return -1
        names = list(self._actions)
        i = names.index(name)
        names[i] = names[-1]
        names.pop()
        self._actions = {n: self._actions[n] for n in dict.fromkeys(names)}
        return 0

    def actions(self) -> list[str]:
        return list(self._actions)

    def invoke(self, name: str, payload: Payload | None = None) -> int:
        """0, or -1 if unknown; without a payload all of it is zero."""
        if name not in self._actions:
            return -1
        self._actions[name](payload or Payload())
        return 0

    # ---- series ----

    def add_series(self, name: str, kind: str = "line") -> int:
        if not name or name in self._series:
            return -1
        self._series[name], self._kinds[name], self._revisions[name] = [], kind, 0
        return 0

    def append(self, name: str, value: float) -> None:
        """Adds a sample; an unknown series begins as a line."""
        if name not in self._series:
            self.add_series(name)
        self._series[name].append(float(value))
        self._revisions[name] += 1

    def clear(self, name: str) -> int:
        if name not in self._series:
            return -1
        self._series[name].clear()
        self._revisions[name] += 1
        return 0

    def revision(self, name: str) -> int:
        return self._revisions.get(name, -1)

    def series(self, name: str) -> list[float] | None:
        return None if name not in self._series else list(self._series[name])

    def series_table(self, spark: SparkSession) -> DataFrame:
        """(series, idx, value) of all series."""
        rows = [(n, i, v) for n, xs in self._series.items() for i, v in enumerate(xs)]
        return spark.createDataFrame(rows, "series string, idx long, value double")
