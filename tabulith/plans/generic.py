"""The analysis of any table: which rule pack fits, and exact totals with their rows where none does.

A pack fires only if the table has every column it requires. Otherwise the confirmed
additive measures that have a label are added up over the scope; the axes are the
declared date column and the column called ``region``, never guessed. Every total
comes with its selection, proof, excluded rows and warnings.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.dates import to_real_date
from tabulith.operators.figures import Evidence, SumSpec, evidence_of
from tabulith.operators.metrics import summed_measures
from tabulith.operators.profile import missing_required, visible_columns
from tabulith.operators.scope import Scope, find_date_column, find_region_column, scope_rows
from tabulith.table import Sheet


@dataclass(frozen=True)
class Generic:
    """``pack``: the first pack whose columns are all there, else None; ``lacking``: what each pack misses;
    ``evidence``: the totals with everything behind them; ``scoped``: the rows of the scope."""

    pack: str | None
    lacking: dict[str, list[str]]
    measures: list[str]
    evidence: Evidence
    scoped: DataFrame


def analyse(sheet: Sheet, scope: Scope, packs: Mapping[str, Sequence[str]], labels: Sequence[str], ledger: DataFrame) -> Generic:
    """Choose a pack and add up what may be added up; a scope of regions over a table without them is empty."""
    lacking = {name: missing_required(sheet.ids, required) for name, required in packs.items()}
    pack = next((name for name, gone in lacking.items() if not gone), None)
    date, region = find_date_column(sheet.columns), find_region_column(sheet.columns)
    measures = summed_measures(sheet.columns, labels)
    specs = [SumSpec(f"total-{m}", m, scope) for m in measures]
    axes = (to_real_date(F.col(date.id)) if date else None, F.col(region.id) if region else None)
    evidence = evidence_of(sheet.rows, specs, *axes, ledger, sheet.sheet_id)
    return Generic(pack, lacking, measures, evidence, scope_rows(sheet.rows, sheet.columns, scope))


def shown_rows(analysis: Generic, sheet: Sheet, fields: Sequence[str] = ()) -> DataFrame:
    """The scope's rows with the columns a reader sees: those a selection names, in its order, else all."""
    return analysis.scoped.select("source_row", *visible_columns(sheet.ids, fields))
