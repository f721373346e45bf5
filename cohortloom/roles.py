"""Names of the columns that play each part: item in series in subject, with a class label."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    item: str = "item"
    series: str = "series"
    subject: str = "subject"
    label: str = "label"
    order: str = "order"
    score: str = "score"
    vector: str = "vector"
