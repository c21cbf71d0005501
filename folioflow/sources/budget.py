"""How much time the tables of a document may take."""

from __future__ import annotations

from dataclasses import dataclass

from ..config import Limits


@dataclass
class TableBudget:
    """Told the seconds that each page's tables took, in order, it says what becomes of them.

    pages: the document has too many, none is looked for. slow: over the limit of a page, dropped.
    over: the page at which the document's budget is spent, dropped as well. stopped: pages after it. kept: all others.
    The seconds of slow pages count, but such a page does not end the search.
    """

    limits: Limits
    pages: int
    spent: float = 0.0
    ended: bool = False

    @property
    def open(self) -> bool:
        """Whether tables are still looked for."""
        return not self.ended and self.pages <= self.limits.max_table_pages

    def judge(self, seconds: float | None) -> str:
        if not self.open:
            return "stopped" if self.ended else "pages"
        self.spent += seconds or 0.0
        if (seconds or 0.0) > self.limits.table_page_seconds:
            return "slow"
        self.ended = self.spent > self.limits.table_budget
        return "over" if self.ended else "kept"
