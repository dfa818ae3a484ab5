"""Constraint checks: every function returns violations, empty means valid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.dates import is_valid_date
from tabulith.functions.decimals import (
    is_decimal,
    is_integer,
    results_agree,
    significant_digits,
)
from tabulith.functions.text import trim_blanks
from tabulith.operators.ordinals import null_safe_join
from tabulith.policy import POLICY
from tabulith.table import ColumnInfo


def rules(df: DataFrame, object_id: str, tests: Mapping[str, Column]) -> DataFrame:
    """(rule, object_id) for each row and test that is true; one narrow pass."""
    hits = F.filter(
        F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]),
        lambda x: x.isNotNull(),
    )
    return df.select(F.col(object_id).cast("string").alias("object_id"), F.explode(hits).alias("rule")).select(
        "rule", "object_id"
    )


def repeated_ids(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their count (map-side combined)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def status_triple(df: DataFrame, id_: str) -> DataFrame:
    """Defined needs a finite value and no reason, undefined the reverse."""
    defined, undefined = F.col("status") == "defined", F.col("status") == "undefined"
    return rules(
        df,
        id_,
        {
            "status.defined.value": defined & ~is_decimal(F.col("value")),
            "status.defined.reason": defined & F.col("reason").isNotNull(),
            "status.undefined.value": undefined & F.col("value").isNotNull(),
            "status.undefined.reason": undefined & (F.coalesce("reason", F.lit("")) == ""),
        },
    )


def scope_dates(df: DataFrame, id_: str, start: str, end: str) -> DataFrame:
    s, e = F.col(start), F.col(end)
    both = s.isNotNull() & e.isNotNull()
    return rules(
        df,
        id_,
        {
            "scope.period.half": s.isNull() != e.isNull(),
            "scope.period.date": both & ~(is_valid_date(s) & is_valid_date(e)),
            "scope.period.order": both & is_valid_date(s) & is_valid_date(e) & (s > e),
        },
    )


def dangling(children: DataFrame, key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Distinct child keys with no parent row: (rule, object_id, n)."""
    per_key = children.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    missing = per_key.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("object_id"), "n")


def cell_values(rows: DataFrame, columns: Sequence[ColumnInfo]) -> DataFrame:
    """(rule, object_id, field) for cells that break their declared column."""
    hits = []
    for c in columns:
        v = F.col(f"`{c.id}`")
        tests: dict[str, Column] = {}
        if not c.nullable:
            tests["cell.nullable"] = v.isNull()
        if c.type == "date":
            tests["cell.date"] = v.isNotNull() & ~is_valid_date(v)
        if c.type == "boolean":
            tests["cell.type"] = v.isNotNull() & ~v.isin("true", "false")
        if c.type in ("decimal", "integer"):
            ok = is_decimal(v)
            tests["cell.decimal"] = v.isNotNull() & ~ok
            tests["cell.significantDigits"] = ok & (significant_digits(v) > POLICY.max_significant_digits)
        if c.type == "integer":
            tests["cell.integer"] = is_decimal(v) & ~is_integer(v)
        hits += [
            F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(c.id).alias("field")))
            for n, t in tests.items()
        ]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return rows.select(F.col("source_row").alias("object_id"), F.explode(found).alias("x")).select(
        "x.rule", F.col("object_id").cast("string").alias("object_id"), "x.field"
    )


def table_internals(
    rows: DataFrame, ledger: DataFrame, sheet_id: str, header_row: int, first_row: int, last_row: int,
    columns: Sequence[str], grain: Sequence[str], calendar: DataFrame,
) -> DataFrame:
    """Row id binding and range, ledger references, grain columns, calendar dates."""
    at = F.col("source_row")
    binding = rules(
        rows,
        "row_id",
        {
            "row.id.binding": F.col("row_id") != F.concat(F.lit(f"{sheet_id}:R"), at.cast("string")),
            "row.sourceRow.range": (at < first_row) | (at > last_row) | (at == header_row),
        },
    )
    kept = ledger.filter(F.col("canonical_row").isNotNull()).join(
        rows.select(F.col("source_row").alias("canonical_row")), "canonical_row", "left_anti"
    )
    fields = rules(ledger, "issue_id", {"issue.fieldId": F.col("field").isNotNull() & ~F.col("field").isin(*columns)})
    days = rules(calendar, "date", {"calendar.date": ~is_valid_date(F.col("date"))})
    repeated = repeated_ids(calendar, ["date"]).select(F.lit("calendar.unique").alias("rule"), F.col("date").alias("object_id"))
    parts = [binding, fields, days, repeated,
             kept.select(F.lit("issue.canonicalRow").alias("rule"), F.col("issue_id").alias("object_id"))]
    undeclared = [g for g in grain if g not in set(columns)]
    if undeclared:
        spark = rows.sparkSession
        parts.append(spark.createDataFrame([("grain.column", g) for g in undeclared], "rule string, object_id string"))
    return reduce(DataFrame.unionByName, parts)


def one_row_equal(claimed: DataFrame, expected: DataFrame, prefix: str) -> DataFrame:
    """Fields of two one-row frames that differ: (rule, object_id, claimed, expected)."""
    names = [c for c in expected.columns]
    e = expected.select(F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias("e")).scalar()
    both = claimed.select(*[F.col(c).cast("string").alias(c) for c in names]).withColumn("_e", e)
    diffs = F.array(
        *[
            F.when(
                ~F.col(c).eqNullSafe(F.col(f"_e.{c}")),
                F.struct(
                    F.lit(f"{prefix}.{c}").alias("rule"), F.lit(c).alias("object_id"),
                    F.col(c).alias("claimed"), F.col(f"_e.{c}").alias("expected"),
                ),
            )
            for c in names
        ]
    )
    return both.select(F.explode(F.filter(diffs, lambda x: x.isNotNull())).alias("d")).select("d.*")


def source_ranges(sources: DataFrame, id_: str) -> DataFrame:
    return rules(
        sources,
        id_,
        {
            "range.order": (F.col("first_row") > F.col("last_row")) | (F.col("first_column") > F.col("last_column")),
            "range.headerRow": ~F.col("header_row").between(F.col("first_row"), F.col("last_row")),
        },
    )


def units(df: DataFrame, id_: str, currencies: DataFrame) -> DataFrame:
    """Currency units without a code, or with one that is not in the dimension."""
    money = df.filter(F.col("unit_kind") == "currency")
    absent = money.filter(F.col("currency").isNull()).select(
        F.lit("unit.currency.missing").alias("rule"), F.col(id_).cast("string").alias("object_id")
    )
    unknown = money.filter(F.col("currency").isNotNull()).join(currencies, "currency", "left_anti").select(
        F.lit("unit.currency.unsupported").alias("rule"), F.col(id_).cast("string").alias("object_id")
    )
    return absent.unionByName(unknown)


def undeclared_labels(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    return df.select(F.col(key).alias("label")).distinct().join(labels, "label", "left_anti")


def reconcile(claimed: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two keyed figure tables: (key, status, claimed, expected)."""
    c = claimed.select(key, F.col(value).alias("claimed"), F.lit(True).alias("_c"))
    e = expected.select(F.col(key).alias("_k"), F.col(value).alias("expected"), F.lit(True).alias("_e"))
    joined = c.join(e, c[key] == e["_k"], "full_outer")
    status = (
        F.when(F.col("_e").isNull(), "unknown-field")
        .when(F.col("_c").isNull(), "missing-claim")
        .when(results_agree(F.col("claimed"), F.col("expected")), "match")
        .otherwise("mismatch")
    )
    return joined.select(F.coalesce(key, "_k").alias(key), status.alias("status"), "claimed", "expected")


def chart_parity(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """Chart values that differ from the metric at the same position.

    ``points`` holds (chart_id, point, values, metric_ids) with paired arrays.
    """
    pairs = points.select(
        "chart_id", "point", F.posexplode(F.arrays_zip("values", "metric_ids")).alias("pos", "p")
    ).select("chart_id", "point", "pos", F.col("p.values").alias("shown"), F.col("p.metric_ids").alias("metric_id"))
    joined = pairs.filter(F.col("shown").isNotNull()).join(metrics.select("metric_id", "value"), "metric_id", "left")
    rule = F.when(F.col("value").isNull(), "chart.no-metric").when(
        ~results_agree(F.col("shown"), F.col("value")), "chart.mismatch"
    )
    return joined.withColumn("rule", rule).filter("rule is not null").select("chart_id", "point", "pos", "metric_id", "rule")


def parity_of_dimensions(reference: DataFrame, candidate: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gap): missing, extra, empty, or with other ``{placeholder}`` names."""
    r = reference.select(F.col(key).alias("_rk"), F.col(text).alias("_rt"))
    c = candidate.select(F.col(key).alias("_ck"), F.col(text).alias("_ct"))
    holders = lambda t: F.array_join(F.array_sort(F.regexp_extract_all(t, F.lit(r"\{([^{}]+)\}"), F.lit(1))), ",")
    joined = r.join(c, F.col("_rk") == F.col("_ck"), "full_outer")
    gaps = F.array(
        F.when(F.col("_ck").isNull(), "missing-key"),
        F.when(F.col("_rk").isNull(), "extra-key"),
        F.when(holders(F.col("_rt")) != holders(F.col("_ct")), "placeholder-mismatch"),
        F.when(F.col("_rk").isNotNull() & (trim_blanks(F.col("_ct")) == ""), "empty-value"),
    )
    found = F.explode(F.filter(gaps, lambda x: x.isNotNull()))
    return joined.select(F.coalesce("_rk", "_ck").alias(key), found.alias("gap"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids two namespaces share; scenario and baseline ids must not."""
    return a.select(key).intersect(b.select(key))


def undeclared_groups(present: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    return present.select(key).distinct().exceptAll(declared.select(key).distinct())


def group_expectations(fact: DataFrame, keys: Sequence[str], value: Column, expected: DataFrame, name: str) -> DataFrame:
    """Group sums against declared ones: (keys, status, actual, expected)."""
    actual = fact.groupBy(*keys).agg(F.sum(value).cast("string").alias("actual"))
    e = expected.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.col(name).alias("expected"))
    cond = reduce(lambda a, b: a & b, [actual[k].eqNullSafe(e[f"_e_{k}"]) for k in keys])
    joined = actual.join(e, cond, "full_outer")
    status = (
        F.when(F.col("expected").isNull(), "undeclared")
        .when(F.col("actual").isNull(), "absent")
        .when(F.col("actual") == F.col("expected"), "match")
        .otherwise("mismatch")
    )
    return joined.select(*[F.coalesce(k, f"_e_{k}").alias(k) for k in keys], status.alias("status"), "actual", "expected")


def manifest(df: DataFrame, id_: str) -> DataFrame:
    """Declared dataset counts that contradict each other."""
    return rules(
        df,
        id_,
        {
            "manifest.records": F.col("clean_records") > F.col("raw_records"),
            "manifest.issueCount": F.col("issues") != F.col("duplicates") + F.col("categories") + F.col("missing"),
            "manifest.qualityStatus": F.col("resolved") + F.col("unresolved") != F.col("issues"),
        },
    )


def hash_binding(landed: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Landed files whose bytes do not carry the declared hash: (key, rule)."""
    d = declared.select(key, F.col("sha256").alias("_want"))
    joined = null_safe_join(landed.select(key, "sha256"), d, [key], "left")
    rule = F.when(F.col("_want").isNull(), "hash.undeclared").when(F.col("_want") != F.col("sha256"), "hash.mismatch")
    return joined.withColumn("rule", rule).filter("rule is not null").select(key, "rule")


def bundle_parts(parts: DataFrame, id_: str) -> DataFrame:
    """Bundles whose table, snapshot and scenario do not belong together.

    ``parts`` holds the identities side by side, one row per bundle: table_id,
    revision, source_hash, then the same with a ``snapshot_`` prefix, analysis_id
    and the scenario's baseline_id (null without a scenario).
    """
    same = lambda c: F.col(c).eqNullSafe(F.col(f"snapshot_{c}"))
    return rules(
        parts,
        id_,
        {
            "snapshot.tableId": ~same("table_id"),
            "normalizationRevision.mismatch": ~same("revision"),
            "sourceHash.mismatch": ~same("source_hash"),
            "export.scenarioBaseline": F.col("baseline_id").isNotNull() & (F.col("baseline_id") != F.col("analysis_id")),
        },
    )


def stand_alone_findings(findings: DataFrame) -> DataFrame:
    """Findings whose rank is not a pair of finite decimals or that name no figure."""
    return rules(
        findings,
        "finding_id",
        {
            "finding.rank": ~is_decimal(F.col("coverage")) | ~is_decimal(F.col("rank_magnitude")),
            "finding.metricId": F.size("metric_ids") == 0,
        },
    )


def stand_alone_definitions(definitions: DataFrame, id_: str) -> DataFrame:
    """Scenario definitions with crossed bounds or a default that is off the step."""
    wide = lambda c: F.col(c).cast("decimal(38,18)")
    return rules(
        definitions,
        id_,
        {
            "definition.bounds": wide("minimum") > wide("maximum"),
            "definition.step": (wide("step") == 0) | (wide("default") % F.when(wide("step") != 0, wide("step")) != 0),
        },
    )


def file_shapes(records: DataFrame, declared: DataFrame) -> DataFrame:
    """(file_id, rule, expected, actual) where a landed file breaks its declared shape.

    ``declared`` holds file_id, records, header_columns and widest; a file is
    reduced to three numbers map-side before it meets its declaration.
    """
    actual = records.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("records"),
        F.max(F.when(F.col("ordinal") == 1, F.size("fields"))).cast("long").alias("header_columns"),
        F.max(F.size("fields")).cast("long").alias("widest"),
    )
    names = ("records", "header_columns", "widest")
    d = declared.select(F.col("file_id").alias("_f"), *[F.col(n).cast("long").alias(f"_{n}") for n in names])
    joined = actual.join(d, F.col("file_id") == F.col("_f"), "full_outer")
    diffs = [
        F.when(
            ~F.col(n).eqNullSafe(F.col(f"_{n}")),
            F.struct(F.lit(f"shape.{n}").alias("rule"), F.col(f"_{n}").alias("expected"), F.col(n).alias("actual")),
        )
        for n in names
    ]
    found = F.explode(F.filter(F.array(*diffs), lambda x: x.isNotNull()))
    return joined.select(F.coalesce("file_id", "_f").alias("file_id"), found.alias("x")).select("file_id", "x.*")
