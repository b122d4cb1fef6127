"""A log of numbered commits: the current values of names, changed by compare and set.

Commit ``n`` is a file that is created only if it is absent, so of two writers that start from the same
state one is refused. Every ``EVERY`` commits the values are written in full, so a reader opens one such
file and the few commits after it; commits lie in folders of ``FOLDER``, so it lists few names as well.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from casegrid.sources import fs

EVERY = 10
FOLDER = 100


class Conflict(RuntimeError):
    """Somebody else has changed what a commit was made from."""


@dataclass(frozen=True)
class State:
    """Values as of a commit."""

    version: int = 0
    values: dict[str, Any] = field(default_factory=dict)


def _path(root: str, kind: str, number: int) -> str:
    return f"{root}/{kind}/{number // FOLDER:012d}/{number:014d}.json"


def _newest(spark: SparkSession, root: str, kind: str) -> int:
    """The largest number of a kind; 0 where there is none."""
    folders = fs.names(spark, f"{root}/{kind}")
    if not folders:
        return 0
    return max((int(n[:-5]) for n in fs.names(spark, f"{root}/{kind}/{folders[-1]}") if len(n) == 19), default=0)


def read(spark: SparkSession, root: str) -> State:
    """The newest state."""
    version, full = _newest(spark, root, "commits"), _newest(spark, root, "full")
    values = json.loads(fs.read_text(spark, _path(root, "full", full))) if full else {}
    for number in range(full + 1, version + 1):
        values.update(json.loads(fs.read_text(spark, _path(root, "commits", number))))
    return State(max(version, full), values)


def commit(spark: SparkSession, root: str, base: State, changes: dict[str, Any]) -> State:
    """The state after ``changes`` to ``base``; :class:`Conflict` if there is a commit after that already."""
    number = base.version + 1
    if not fs.create_text(spark, _path(root, "commits", number), json.dumps(changes)):
        raise Conflict(f"commit {number} below {root} is taken")
    after = State(number, {**base.values, **json.loads(json.dumps(changes))})
    if number - _newest(spark, root, "full") >= EVERY:
        fs.create_text(spark, _path(root, "full", number), json.dumps(after.values))
    return after


def publish(spark: SparkSession, root: str, base: State, changes: dict[str, Any], guard: tuple[str, ...] = ()) -> State:
    """Commit on top of whatever the newest state is, as long as the guarded names are as they were in ``base``."""
    while True:
        now = read(spark, root)
        for name in guard:
            if now.values.get(name) != base.values.get(name):
                raise Conflict(f"{name} has been changed since commit {base.version}")
        try:
            return commit(spark, root, now, changes)
        except Conflict:
            continue
