"""Where the tables of one deployment live."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    root: str

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"
