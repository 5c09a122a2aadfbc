"""Column roles of an event-sequence table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    event: str = "event_id"
    entrant: str = "entrant"
    group: str = "grp"
    venue: str = "venue"
    season: str = "season"
    date: str = "event_date"
    order: tuple[str, ...] = ("event_date", "event_id")
    position: str = "position"
    finish_order: str = "finish_order"
    points: str = "points"
