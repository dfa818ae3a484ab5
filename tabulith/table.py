"""The two shapes every operator works on: a wide sheet and its column facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ColumnInfo:
    """One declared or proposed column of a sheet."""

    id: str
    label: str
    source_column: int
    type: str = "text"
    role: str = "dimension"
    unit_kind: str = "unknown"
    currency: str | None = None
    additive: bool = False
    confirmed: bool = False
    nullable: bool = True

    def with_(self, **changes) -> "ColumnInfo":
        return replace(self, **changes)


@dataclass(frozen=True)
class Sheet:
    """Wide text rows of one landed table, keyed by a physical ``source_row``.

    ``rows`` holds ``source_row`` (unique, positive) and one text column per id.
    A sheet that came from spreadsheet cells also carries ``<id>__kind``,
    ``<id>__formula`` and ``<id>__cached`` for the columns in ``kinds``.
    """

    rows: DataFrame
    columns: tuple[ColumnInfo, ...]
    sheet_id: str = "S0"
    header_row: int = 1
    kinds: frozenset[str] = frozenset()

    @property
    def ids(self) -> list[str]:
        return [c.id for c in self.columns]

    def column(self, id_: str) -> ColumnInfo:
        for c in self.columns:
            if c.id == id_:
                return c
        raise KeyError(f"sheet has no column {id_!r}")

    def with_columns(self, columns: Sequence[ColumnInfo]) -> "Sheet":
        return replace(self, columns=tuple(columns))

    def kind_of(self, id_: str) -> Column:
        return F.col(f"`{id_}__kind`") if id_ in self.kinds else F.lit("text")


def sheet_from_table(df: DataFrame, key: str, columns: Sequence[str], offset: int = 2) -> Sheet:
    """Read a typed table as a sheet: every column as text, ``key + offset`` as row.

    The offset leaves row 1 to the header, so a zero-based key starts at row 2.
    """
    rows = df.select(
        (F.col(key).cast("long") + offset).alias("source_row"),
        *[F.col(c).cast("string").alias(c) for c in columns],
    )
    infos = tuple(ColumnInfo(id=c, label=c, source_column=i + 1) for i, c in enumerate(columns))
    return Sheet(rows=rows, columns=infos)
