"""Every threshold, window, cap and clock of the library, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime


@dataclass(frozen=True)
class Params:
    as_of: date = date(1998, 7, 1)
    now: datetime = datetime(2024, 1, 31)
    tz: str = "Asia/Seoul"
    due_choices: tuple[int, ...] = (7, 14, 30)
    urgent_days: int = 7
    urgent_shown: int = 5
    imminent_days: int = 14
    page_size: int = 9
    page_most: int = 100
    upcoming: int = 15
    item_cap: int = 40
    probe: int = 2000
    prompt: int = 6000
    detail: int = 8000
    notice: int = 4000
    fresh_hours: int = 6
    stale_hours: int = 72
    title_ratio: float = 0.9
    title_days: int = 1
    cosine: float = 0.92
    prefilter: float = 0.62
    embeddings_a_run: int = 30
    threshold: float = 50.0
    night: tuple[int, int] = (23, 7)
    night_least: float = 80.0
    night_blocked: float = 101.0
    per_minute: int = 17
    per_round: int = 12
    spacing_seconds: float = 3.5
    a_run: int = 24
    drained: int = 16
    retries: int = 3
    outage_minutes: int = 30
    slot_hours: tuple[int, ...] = (9, 15)
    slot_gap_hours: int = 1
    daily_calls: int = 100
    own_calls: int = 50
    quote_minutes: int = 15
    chat_questions: int = 30
    draft_hours: int = 24
    body_days: int = 30
    history_days: int = 45
    history_rows: int = 400
    report_items: int = 120
    calm: tuple[int, int, int] = (20, 10, 10)  # candidates, new ones and backlog below which a recovery is over
    closed: tuple[str, ...] = ("F",)
    ranks: dict[str, int] = field(default_factory=lambda: {"high": 4, "medium": 3, "low": 2, "none": 1, "": 0})


DEFAULT = Params()
