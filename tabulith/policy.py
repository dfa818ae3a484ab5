"""Thresholds and limits every operator reads, in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class Limits:
    """Landing limits; ``None`` switches a limit off (the default at scale)."""

    input_bytes: int | None = None
    rows_including_header: int | None = None
    columns: int | None = None
    nonempty_cells: int | None = None
    cell_characters: int | None = None

    # The interactive limits of version 1.0.0.
    @staticmethod
    def interactive() -> "Limits":
        return Limits(
            input_bytes=10_485_760,
            rows_including_header=50_000,
            columns=100,
            nonempty_cells=500_000,
            cell_characters=32_000,
        )


@dataclass(frozen=True)
class Policy:
    # Policy version 1.0.0.
    version: str = "1.0.0"
    quotient_digits: int = 40
    max_significant_digits: int = 30
    spreadsheet_significant_digits: int = 15
    numeric_share: float = 0.95
    date_share: float = 0.98
    min_comparison_rows: int = 20
    target_gap: Decimal = Decimal("0.05")
    period_change: Decimal = Decimal("0.10")
    materiality_share: Decimal = Decimal("0.05")
    orders_increase: Decimal = Decimal("0.05")
    outlier_min_rows: int = 30
    iqr_multiplier: int = 3
    trend_periods: int = 4
    finding_cap: int = 3
    headline_cap: int = 4
    max_page: int = 500
    preview_records: int = 30
    delimiter_sample_chars: int = 65_536
    type_sample_size: int = 2_000
    scenario_min: Decimal = Decimal("-0.20")
    scenario_max: Decimal = Decimal("0.30")
    scenario_step: Decimal = Decimal("0.001")
    limits: Limits = field(default_factory=Limits)


POLICY = Policy()
