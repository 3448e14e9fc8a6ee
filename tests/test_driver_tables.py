"""Profiles of the driver tables against FIXTURES.md §2 (roles computed with
DuckDB distinct counts), and the whole report on the odd-shaped tables."""

import pytest

from tablelens.plans import profile as P

SF01 = "/root/testdata/sf0.01"
# table -> (dataset type, primary measure, {column: role} spot checks), sf0.01
EXPECTED = {
    "region": ("Cross-sectional", "r_regionkey", {"r_name": "categorical"}),
    "nation": ("Cross-sectional", "n_nationkey", {"n_name": "categorical", "n_regionkey": "numeric"}),
    "customer": ("Cross-sectional", "c_acctbal", {"c_name": "id", "c_mktsegment": "categorical"}),
    "supplier": ("Numeric Only", "s_acctbal", {"s_name": "id"}),
    "part": ("Cross-sectional", "p_partkey", {"p_type": "categorical", "p_name": "categorical"}),
    "orders": ("Time Series", "o_totalprice", {"o_orderdate": "date", "o_orderstatus": "categorical"}),
    "lineitem": ("Time Series", "l_quantity", {"l_shipdate": "date", "l_returnflag": "categorical"}),
    "events": ("Time Series", "value", {"event_id": "id", "user_id": "numeric", "props": "categorical"}),
    "documents": ("Cross-sectional", "n_chars", {"doc_id": "id", "text": "id", "lang": "categorical"}),
    "embeddings": ("Numeric Only", "label", {"embedding": "unsupported"}),
    "pages": ("Unstructured", None, {"page_id": "id", "url": "id", "html": "id"}),
    "benchmark": ("Cross-sectional", None, {"item_id": "id", "text": "categorical"}),
    "labels": ("Unstructured", None, {"doc_id": "id", "quality": "boolean", "toxic": "boolean"}),
    "conversations": ("Cross-sectional", "conv_id", {"role": "categorical", "text": "id"}),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_profile_of_driver_table(spark, name):
    kind, primary, roles = EXPECTED[name]
    p = P.build_profile(spark.read.parquet(f"{SF01}/{name}.parquet"))
    assert p.dataset_type == kind and p.primary_measure == primary
    for c, r in roles.items():
        assert p.roles[c] == r, (c, p.roles[c])


def test_semantic_roles_of_driver_tables(spark):
    ev = P.build_profile(spark.read.parquet(f"{SF01}/events.parquet"))
    assert ev.semantic_roles["amount"] == ["value"] and ev.semantic_roles["category"] == ["event_type"]
    li = P.build_profile(spark.read.parquet(f"{SF01}/lineitem.parquet"))
    assert li.semantic_roles["quantity"] == ["l_quantity"]
    pa = P.build_profile(spark.read.parquet(f"{SF01}/part.parquet"))
    assert pa.semantic_roles["category"] == ["p_type"]


@pytest.mark.parametrize("name", ["events", "embeddings", "pages", "labels"])
def test_report_on_odd_tables(spark, name):
    from tablelens.plans.report import collect_all, dashboard
    d = dashboard(spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    res = collect_all(d.frames())
    assert res["kpis"][0]["label"] == "Total Records" and len(res["insights"]) > 0
    d.release()
