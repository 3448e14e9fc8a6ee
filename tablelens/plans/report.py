"""Run-everything entry: profile a table once, then compute its KPI cards,
chart datasets and insight report (the reference's upload -> dashboard ->
insight flow)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tablelens.operators.ingest import normalize_missing
from tablelens.plans import charts as C
from tablelens.plans import insights as IN
from tablelens.plans import kpi as K
from tablelens.plans import profile as P
from tablelens.session import stage


class EmptyTableError(ValueError):
    """IO2: the table has no rows, so there is nothing to analyse."""


@dataclass
class Dashboard:
    profile: P.Profile
    base: DataFrame
    kpis: DataFrame
    charts: DataFrame
    insights: DataFrame | None
    cached: list = field(default_factory=list)

    def release(self) -> None:
        """Drop every block the dashboard and its quality page cached."""
        while self.cached:
            self.cached.pop().unpersist()

    def frames(self) -> dict[str, DataFrame]:
        out = {"kpis": self.kpis, "charts": self.charts}
        if self.insights is not None:
            out["insights"] = self.insights
        return out


def dashboard(df: DataFrame, persist: str | None = None, template: str | None = None,
              with_insights: bool = True, filtered: DataFrame | None = None,
              approx_distinct: bool = False, approx: bool = False) -> Dashboard:
    """Profile ``df`` (S14: the profile describes the unfiltered rows), then
    plan KPIs, charts and insights over ``filtered`` (default: ``df``).

    ``persist`` keeps the normalised rows for the report's jobs (see
    ``session.stage``; None: each job reads its columns from the source).
    Call ``release()`` on the result when it is no longer needed.
    ``approx_distinct`` profiles with HyperLogLog distinct counts (no value
    shuffle); ``approx`` also switches the insight report's quartiles to
    sketches: both for very large tables. The returned frames are lazy;
    ``collect_all`` runs them."""
    raw = stage(normalize_missing(df), persist)
    cached = [raw] if persist == "persist" else []
    prof = P.build_profile(raw, template=template, approx_distinct=approx_distinct or approx)
    if prof.rows == 0:
        for frame in cached:
            frame.unpersist()
        raise EmptyTableError("the table has no rows")
    same = filtered is None
    src = raw if same else stage(normalize_missing(filtered), persist)
    if persist == "persist" and not same:
        cached.append(src)
    base = P.prepare(src, prof)  # projections over the staged rows
    kpis = K.build_kpis(base, prof, profile_counts=same)
    charts = C.auto_charts(base, prof, profile_counts=same)
    ins = IN.insight_report(base, prof, exact=not approx) if with_insights else None
    return Dashboard(prof, base, kpis, charts, ins, cached)


def quality_page(d: Dashboard, duplicate_listing: int = 50, top_pairs: int = 10) -> dict[str, DataFrame]:
    """The data-quality page over the dashboard's rows: missing values per
    column (A12), duplicate count and first duplicated rows (D1, D2),
    uniqueness (A13), outlier table (A10), box summaries of the two columns
    with most outliers (A8), strongest correlations (A11), metadata (A14),
    the export summary (IO4) and a preview (IO5). Lazy frames; the health
    row behind several of them is computed once."""
    from tablelens.operators import distribution as D
    from tablelens.operators import quality as Q
    from tablelens.sources.files import preview

    base, prof = d.base, d.profile
    nums = prof.schema["numeric"]
    health = Q.health(base).cache()
    d.cached.append(health)
    return {
        "missing": Q.missing_by_column(base),
        "duplicate_count": health.select("dup_rows", "dup_pct"),
        "duplicate_rows": Q.duplicate_rows(base, duplicate_listing),
        "uniqueness": Q.uniqueness(base),
        "outliers": D.outliers(base, nums),
        "box_columns": D.box_columns(base, nums, 2),
        "correlation": D.corr_top(base, nums, top_pairs),
        "metadata": Q.metadata(health, prof.role_counts()),
        "summary": Q.export_summary(health),
        "preview": preview(base, 10),
    }


def collect_all(frames: dict[str, DataFrame], threads: int = 4) -> dict[str, list]:
    """Run independent result frames as concurrent Spark jobs (one driver
    thread each); their stages share the executors."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(frames)))) as ex:
        futures = {k: ex.submit(v.collect) for k, v in frames.items()}
        return {k: f.result() for k, f in futures.items()}
