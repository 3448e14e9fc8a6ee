"""Profiling (P1, P3-P6, P8): column roles, business meanings, primary
measure, per-column profile and the capped JSON summary.

Cost: one aggregate for the date layouts of all date-named text columns (if
there are any) and one pass (``quality.column_stats``) for all columns
together. The decisions themselves are made on the driver over one small row
per column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions import names as N
from tablelens.functions import rules as R
from tablelens.functions.columns import is_boolean, is_numeric, is_string, is_supported, is_temporal, qcol
from tablelens.operators import ingest as I
from tablelens.operators.quality import column_stats

ROLES = ["date", "numeric", "categorical", "id", "boolean"]


@dataclass(frozen=True)
class Profile:
    roles: dict[str, str | None]              # column -> role (None: no values)
    schema: dict[str, list[str]]              # role -> columns, in column order
    semantic_roles: dict[str, list[str]]
    rows: int
    columns: list[str]
    dtypes: dict[str, str]
    n: dict[str, int]
    nunique: dict[str, int]
    missing_pct: dict[str, float]
    primary_measure: str | None
    dataset_type: str
    numeric_text: list[str] = field(default_factory=list)
    date_formats: dict[str, str] = field(default_factory=dict)
    bounds: dict[str, tuple] = field(default_factory=dict)  # numeric column -> (min, max)
    approx: bool = False  # distinct counts are sketches

    def role_counts(self) -> dict[str, int]:
        return {r: len(self.schema.get(r, [])) for r in ROLES}


def role_expr() -> F.Column:
    """Role of a column from its metadata row: ``kind`` ('temporal',
    'numeric', 'boolean', 'string', 'unsupported'), ``n`` non-missing values,
    ``nuniq`` distinct values, ``id_name`` (name has an id token), ``date_ok``
    (date-named text whose values all parse) and ``numeric_text``. First
    matching rule wins."""
    k, n, u = F.col("kind"), F.col("n"), F.col("nuniq")
    id_name = F.col("id_name")
    return (F.when(k == "unsupported", "unsupported")
            .when(n == 0, F.lit(None))
            .when(k == "temporal", "date")
            .when((k == "string") & F.col("date_ok"), "date")
            .when(k == "boolean", "boolean")
            .when((k == "numeric") & (u <= R.BOOLEAN_MAX_DISTINCT), "boolean")
            .when((k == "numeric") & id_name & (u > R.NUMERIC_ID_MIN_SHARE * n), "id")
            .when(k == "numeric", "numeric")
            .when(F.col("numeric_text"), "numeric")
            .when(id_name & (u > R.TEXT_ID_MIN_SHARE * n), "id")
            .when((u <= N.CAT_UNIQUE_LIMIT) | (u / F.greatest(n, F.lit(1)) < R.CATEGORICAL_MAX_SHARE),
                  "categorical")
            .otherwise("id"))


def column_kind(df: DataFrame, c: str) -> str:
    if not is_supported(df, c):
        return "unsupported"
    if is_temporal(df, c):
        return "temporal"
    if is_boolean(df, c):
        return "boolean"
    if is_numeric(df, c):
        return "numeric"
    return "string"


def semantic_roles(schema: dict[str, list[str]]) -> dict[str, list[str]]:
    """Business meanings by whole-token name match, columns listed in
    role order numeric, categorical, date, id, boolean."""
    ordered = [c for r in ["numeric", "categorical", "date", "id", "boolean"] for c in schema.get(r, [])]
    out = {}
    for role, kws in N.SEMANTIC_ROLE_HINTS.items():
        cols = [c for c in ordered if N.matches(c, kws)]
        if cols:
            out[role] = cols
    return out


def pick_primary_measure(df: DataFrame, numeric_cols: list[str], template: str | None = None) -> tuple:
    """(column, method). Template keywords first, then the priority
    keywords, then the numeric column with the largest sum (first on ties;
    one aggregate over all numeric columns)."""
    if not numeric_cols:
        return None, None
    for kw in N.TEMPLATE_HINTS.get(template or "", []):
        for c in numeric_cols:
            if N.matches(c, [kw]):
                return c, "template"
    for kw in N.PRIMARY_MEASURE_PRIORITY:
        for c in numeric_cols:
            if N.matches(c, [kw]):
                return c, "keyword"
    from tablelens.functions.columns import as_double
    from tablelens.operators.ingest import money_value
    sums = []
    for i, c in enumerate(numeric_cols):
        v = money_value(qcol(c)) if is_string(df, c) else as_double(df, c)
        sums.append(F.sum(v).alias(f"s{i}"))
    r = df.agg(*sums).collect()[0]
    best, best_v = None, None
    for i, c in enumerate(numeric_cols):
        v = r[f"s{i}"]
        if v is not None and (best_v is None or v > best_v):
            best, best_v = c, v
    return (best or numeric_cols[0]), "largest_sum"


def date_layouts(df: DataFrame) -> dict[str, str]:
    """{date-named text column: its layout}, for those whose values all have one."""
    return I.detect_date_formats(df, [c for c in df.columns if column_kind(df, c) == "string" and N.matches(c, N.DATE_HINTS)])


def role_frame(df: DataFrame, approx_distinct: bool = False, layouts: dict[str, str] | None = None) -> DataFrame:
    """(column, position, rows, n, nuniq, role) for every column. One
    job computes counts, distinct counts and the numeric-text test for all
    columns (``quality.column_stats``); name tests ride along as literals.
    Date-named text columns are tested as a whole first."""
    cols = df.columns
    kinds = {c: column_kind(df, c) for c in cols}
    date_ok = date_layouts(df) if layouts is None else layouts
    meta = {c: {"kind": kinds[c], "id_name": N.matches(c, N.ID_HINTS), "date_ok": c in date_ok} for c in cols}
    st = column_stats(df, meta, approx=approx_distinct).withColumnRenamed("nunique", "nuniq")
    out = st.select("column", "position", "rows", "n", "nuniq", role_expr().alias("role"), "lo", "hi")
    unsupported = [c for c in cols if kinds[c] == "unsupported"]
    if unsupported:
        rows = st.agg(F.max("rows").alias("rows"))
        extra = rows.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(cols.index(c)).cast("long").alias("position"))
            for c in unsupported])).alias("u"), "rows").select(
            "u.column", "u.position", F.coalesce("rows", F.lit(0)).alias("rows"),
            F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("nuniq"),
            F.lit("unsupported").alias("role"), F.lit(None).cast("double").alias("lo"),
            F.lit(None).cast("double").alias("hi"))
        out = out.unionByName(extra)
    return out


def build_profile(df: DataFrame, template: str | None = None, approx_distinct: bool = False) -> Profile:
    """P1+P3+P4+P6 in one call (the role frame has one row per column)."""
    cols = df.columns
    layouts = date_layouts(df)
    rf = {r["column"]: r for r in role_frame(df, approx_distinct, layouts).collect()}
    rows = max([int(r["rows"]) for r in rf.values()], default=0)
    if rows == 0 and cols:
        rows = df.count()
    roles = {c: (rf[c]["role"] if c in rf else None) for c in cols}
    n = {c: (int(rf[c]["n"]) if c in rf else 0) for c in cols}
    nuniq = {c: (int(rf[c]["nuniq"]) if c in rf else 0) for c in cols}
    missing = {c: round((rows - n[c]) / rows * 100, 2) if rows else 0.0 for c in cols}
    schema = {r: [c for c in cols if roles[c] == r] for r in ROLES}
    primary, _ = pick_primary_measure(df, schema["numeric"], template)
    if schema["date"]:
        dtype = "Time Series"
    elif schema["categorical"]:
        dtype = "Cross-sectional"
    elif schema["numeric"]:
        dtype = "Numeric Only"
    else:
        dtype = "Unstructured"
    numeric_text = [c for c in schema["numeric"] if is_string(df, c)]
    date_formats = {c: layouts[c] for c in schema["date"] if c in layouts}
    bounds = {c: (rf[c]["lo"], rf[c]["hi"]) for c in cols
              if c in rf and is_numeric(df, c) and rf[c]["lo"] is not None}
    return Profile(roles=roles, schema=schema, semantic_roles=semantic_roles(schema), rows=rows,
                   columns=list(cols), dtypes={f.name: f.dataType.simpleString() for f in df.schema.fields},
                   n=n, nunique=nuniq, missing_pct=missing, primary_measure=primary, dataset_type=dtype,
                   numeric_text=numeric_text, date_formats=date_formats, bounds=bounds, approx=approx_distinct)


def prepare(df: DataFrame, profile: Profile) -> DataFrame:
    """Apply the profile's coercions (S1: they stick): NaN -> null, numeric
    text -> double, date text -> timestamp."""
    out = I.normalize_missing(df)
    out = out.select(*[I.money_value(qcol(c)).alias(c) if c in profile.numeric_text else qcol(c)
                       for c in out.columns])
    return I.coerce_dates(out, profile.date_formats)


def column_roles(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """P1 as a frame: (column, position, n, nuniq, role)."""
    return role_frame(df, approx_distinct).select("column", "position", "n", "nuniq", "role")


def profile_columns(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """P6 as a frame: (column, position, dtype, role, missing_pct)."""
    p = profile or build_profile(df)
    return df.sparkSession.createDataFrame(
        [(c, i, p.dtypes[c], p.roles[c], float(p.missing_pct[c])) for i, c in enumerate(p.columns)],
        "column string, position long, dtype string, role string, missing_pct double")


def profile_json(df: DataFrame, profile: Profile | None = None, max_cols: int = R.PROFILE_JSON_COLUMNS,
                 sample_rows: int = R.PREVIEW_ROWS) -> DataFrame:
    """One-row JSON summary capped at ``max_cols`` columns and
    ``sample_rows`` rows (the first rows in the order of all columns: a
    top-k, so each task keeps only ``sample_rows``)."""
    import json

    from tablelens.sources.files import preview
    p = profile or build_profile(df)
    cols = p.columns[:max_cols]
    sample = [json.loads(x) for x in
              preview(df.select(*[qcol(c) for c in cols]), sample_rows).select(F.to_json(F.struct("*")).alias("j"))
              .toPandas()["j"]]
    doc = {
        "shape": {"rows": p.rows, "columns": len(p.columns)},
        "dataset_type": p.dataset_type,
        "columns": [{"name": c, "dtype": p.dtypes[c], "missing_pct": p.missing_pct[c]} for c in cols],
        "schema": {r: p.schema[r][:max_cols] for r in ROLES},
        "semantic_roles": p.semantic_roles,
        "primary_measure": p.primary_measure,
        "sample_rows": sample,
        "truncated_columns": max(0, len(p.columns) - max_cols),
    }
    return df.sparkSession.createDataFrame([(json.dumps(doc, default=str),)], "json string")
