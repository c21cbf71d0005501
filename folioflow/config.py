"""Limits and switches of a conversion run, read once on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

MIB = 1024 * 1024
TRUE_WORDS = frozenset(("1", "true", "yes", "on"))


@dataclass(frozen=True)
class Limits:
    """Sizes in bytes, times in seconds."""

    max_source_bytes: int = 100 * MIB
    max_output_bytes: int = 180 * MIB
    max_result_bytes: int = 180 * MIB
    max_members: int = 10_000
    max_expanded_bytes: int = 350 * MIB
    max_ratio: int = 100
    ratio_checked_from: int = 4 * MIB
    deadline: int = 690
    table_page_seconds: int = 5
    table_reserve_seconds: int = 90
    max_table_pages: int = 300
    tables: bool = True
    notes: bool = False
    include_media: bool = True
    child_timeout: int = 600
    word_timeout: int = 345

    @property
    def table_budget(self) -> int:
        return self.deadline - self.table_reserve_seconds


def from_env(env: Mapping[str, str] = os.environ, prefix: str = "FOLIOFLOW_") -> Limits:
    """Limits with what the environment sets; a number that cannot be read leaves the default."""
    found = {}
    for f in fields(Limits):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        if f.type == "bool":
            found[f.name] = raw.strip().lower() in TRUE_WORDS
        else:
            try:
                found[f.name] = int(raw)
            except ValueError:
                continue
    return Limits(**found)
