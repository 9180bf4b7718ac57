"""What each table mode does with a row on either side of the cut-line."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Side(Enum):
    HOT = "hot"
    COLD = "cold"


class Cold(Enum):
    """Where the cold half of a read comes from."""

    MERGED = "pinned lake with overlay"
    LIVE = "live lake"
    NONE = "heap holds all"


@dataclass(frozen=True)
class WritePlan:
    """Stores that a row goes to, or is removed from, and the checks that come first."""

    heap: bool = False
    overlay: bool = False
    lake: bool = False
    check_retention: bool = False
    heap_floor: bool = False


@dataclass(frozen=True)
class TableMode:
    """``base`` is tiered, direct or mirrored; keep_heap and heap_retention refine it."""

    base: str
    keep_heap: bool = False
    heap_retention: bool = False

    def __post_init__(self) -> None:
        if self.base not in ("tiered", "direct", "mirrored"):
            raise ValueError(f"unknown mode {self.base!r}")
        if self.keep_heap and self.base == "mirrored":
            raise ValueError("a mirrored table keeps its heap by itself")
        if self.heap_retention and self.base != "mirrored":
            raise ValueError("heap retention needs a mirrored table")

    @property
    def heap_complete(self) -> bool:
        """The heap alone answers every read."""
        return self.keep_heap or self.base == "mirrored" and not self.heap_retention

    @property
    def routes_by_cut(self) -> bool:
        """Hot and cold rows go to different stores."""
        return not self.heap_complete

    @property
    def direct(self) -> bool:
        return self.base == "direct"

    @property
    def cold_read(self) -> Cold:
        if self.base == "mirrored" and not self.heap_retention:
            return Cold.NONE
        return Cold.LIVE if self.direct else Cold.MERGED

    def insert(self, side: Side) -> WritePlan:
        if side is Side.HOT or self.base == "mirrored" and not self.heap_retention:
            return WritePlan(heap=True)
        return WritePlan(heap=self.keep_heap, overlay=not self.direct, lake=self.direct, check_retention=self.base != "mirrored")

    def delete(self, side: Side) -> WritePlan:
        plan = self.insert(side)
        return WritePlan(plan.heap, plan.overlay, plan.lake, self.routes_by_cut and side is Side.COLD, self.routes_by_cut and side is Side.HOT)

    def update(self, old: Side, new: Side) -> tuple[WritePlan, WritePlan]:
        return self.delete(old), self.insert(new)


def side_of(tier_key: int, cut: int) -> Side:
    return Side.HOT if tier_key >= cut else Side.COLD
