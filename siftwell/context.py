"""Options of an inspection."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Hints and limits. Limits bound previews and reports only; diagnostics read whole tables.

    compat: reproduce two habits of sample-based tools: numbers count as parseable dates in
    feature typing, and nulls count as a class of their own in metric choice.
    """

    target_column: str | None = None
    time_column: str | None = None
    split_column: str | None = None
    group_column: str | None = None
    id_columns: tuple[str, ...] = ()
    task_hint: str | None = None
    objective_metric: str | None = None
    auto_accept: float = 0.85
    max_columns: int = 200
    sniff_bytes: int = 256 * 1024
    load_bytes: int = 10 * 1024 * 1024
    preview_rows: int = 8
    preview_columns: int = 30
    archive_members: int = 20
    max_depth: int = 6
    max_items: int = 40
    compat: bool = True
    exact_quantile_rows: int = 20_000_000
