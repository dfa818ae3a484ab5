"""Text keys, identifiers and small renderings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The blanks a trim removes.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_blanks(s: Column) -> Column:
    """Trim every Unicode blank, not only the ASCII space."""
    return F.btrim(s, F.lit(BLANKS))


def is_blank(s: Column) -> Column:
    return s.isNull() | (s == "")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(s: Column) -> Column:
    """Canonical composition; plain ASCII text bypasses the Python worker's work."""
    ascii_only = s.rlike(r"^[\x00-\x7F]*\z")
    return F.when(ascii_only, s).otherwise(_nfc(F.when(~ascii_only, s)))


def fold_key(s: Column) -> Column:
    """Spelling-insensitive key: composed, trimmed, lower-cased."""
    return F.lower(trim_blanks(nfc(s)))


def slug(label: Column) -> Column:
    body = F.regexp_replace(F.lower(trim_blanks(label)), r"[^a-z0-9؀-ۿ]+", "_")
    bare = F.regexp_replace(body, r"^_+|_+\z", "")
    return F.when(bare == "", F.lit("column")).otherwise(bare)


def column_letter(n: Column) -> Column:
    """Bijective base-26 letters (1 = A, 27 = AA) of any positive long."""
    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("letters"))

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"] - 1
        more = F.struct(F.call_function("div", rest, F.lit(26)).cast("long").alias("rest"), F.concat(F.char(65 + F.pmod(rest, F.lit(26))), state["letters"]).alias("letters"))
        return F.when(state["rest"] > 0, more).otherwise(state)

    # 26 ** 14 exceeds a long.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda state: state["letters"])


def row_id(sheet_id: Column, source_row: Column) -> Column:
    return F.concat(sheet_id, F.lit(":R"), source_row.cast("string"))


def parse_row_id(id_: Column) -> Column:
    """Physical row of ``S<n>:R<row>``; null for any other shape."""
    digits = F.regexp_extract(id_, r"^S[0-9]+:R([0-9]+)\z", 1)
    return F.when(digits != "", digits).cast("long")


def span_token(start: Column, end: Column) -> Column:
    single = F.concat(F.lit("R"), start.cast("string"))
    return F.when(start == end, single).otherwise(F.concat(single, F.lit("-R"), end.cast("string")))


def snapshot_id(table_id: Column, start: Column, end: Column, regions: Column) -> Column:
    period = F.concat_ws("-", F.coalesce(start, F.lit("all")), F.coalesce(end, F.lit("all")))
    names = F.when(F.size(regions) > 0, F.array_join(regions, "+")).otherwise(F.lit("all"))
    return F.concat_ws("-", F.lit("analysis-v1.0.0"), table_id, period, names)


def scenario_id(analysis_id: Column, change: Column) -> Column:
    """The id of a scenario run: the change with ``m`` for minus and no point."""
    digits = F.regexp_replace(F.regexp_replace(change, "-", "m"), r"\.", "")
    return F.concat(F.lit("scenario-"), analysis_id, F.lit("-cost"), digits)


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys; nulls are written out, not dropped."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def sha256_hex(s: Column) -> Column:
    return F.sha2(s, 256)


def starts_like_formula(s: Column) -> Column:
    """Cell a spreadsheet would run: an active character after optional blanks."""
    return F.coalesce(s.rlike(r"^[\t\r ]*[=+\-@]"), F.lit(False))


def guard_formula(s: Column) -> Column:
    """Prefix an apostrophe so that a delimited export stays inert text."""
    return F.when(starts_like_formula(s), F.concat(F.lit("'"), s)).otherwise(s)
