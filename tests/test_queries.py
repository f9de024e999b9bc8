"""Every planning query against its SQL in DuckDB, at the smallest scale."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from ridgeplan.operators import flow as fl
from ridgeplan.plans import design
from ridgeplan.plans import fixtures as fx
from ridgeplan.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(x):
    return round(x, 9) if isinstance(x, float) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(rounded(r[k])) for k in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_which_queries_have_no_sql():
    """The solvers that draw at random or search, and the removals; each is tested below or with the kernels."""
    assert set(QUERIES) - set(ORACLE) == {"elevation_removal", "whole_map_removal", "cluster_removal", "randomised_rounding", "local_search", "search_trace", "fixed_charge_design"}


@pytest.mark.parametrize(("name", "percent"), [("elevation_removal", 90), ("whole_map_removal", 95)])
def test_removal_keeps_its_share(spark, sf_dir, duck, name, percent):
    got = Counter(r.bucket for r in QUERIES[name](spark, sf_dir).collect())
    sizes = duck.sql(f"WITH {fx.CTE} SELECT CAST(z // 10 AS INTEGER), count(*) FROM cell WHERE z IS NOT NULL GROUP BY 1").fetchall()
    assert got == {b: math.ceil(n * (1 - percent / 100)) for b, n in sizes}


def test_cluster_removal_is_repeatable(spark, sf_dir):
    a, b = (sorted(map(tuple, QUERIES["cluster_removal"](spark, sf_dir).collect())) for _ in range(2))
    assert a == b and len({c for _, c in a}) == len(a)


def test_rounding_is_a_flow(spark, sf_dir):
    """Flows add up at every node, all reachable demand arrives, the equipment is the sum of its links."""
    edges = QUERIES["randomised_rounding"](spark, sf_dir).collect()
    net = design.quick_network(spark, sf_dir)
    flow = np.zeros((net.n, net.n), np.int64)
    at = {int(k): i for i, k in enumerate(net.nodes)}
    for e in edges:
        flow[at[e.tail], at[e.head]] += e.flow
        assert np.isfinite(net.cost[at[e.tail], at[e.head]])
    inflow = flow.sum(0) - flow.sum(1)
    plain = fl.min_cost_flow(net.cost, net.source, net.demand)
    assert ((inflow == net.demand) | (inflow == 0))[np.arange(net.n) != net.source].all() and fl._met(net, flow) == fl._met(net, plain)
    assert {e.equipment_cost for e in edges} == {sum(e.pair_cost for e in edges)} and all(e.complete for e in edges)


def test_search_never_gets_dearer(spark, sf_dir):
    rows = {(r.run, r.stage): r for r in QUERIES["local_search"](spark, sf_dir).collect()}
    for run in (0, 1):
        costs = [rows[run, s].equipment_cost for s in fl.STAGES]
        assert costs == sorted(costs, reverse=True)
    trace = QUERIES["search_trace"](spark, sf_dir).collect()
    for run in (0, 1):
        steps = sorted((r.step, r.cost) for r in trace if r.run == run)
        assert [k for k, _ in steps] == list(range(len(steps))) and steps[-1][1] == 0


def test_incumbents_get_better(spark, sf_dir):
    rows = sorted(map(tuple, QUERIES["fixed_charge_design"](spark, sf_dir).collect()))
    assert rows and all(b[3] > a[3] or (b[3] == a[3] and b[1] < a[1]) for a, b in zip(rows, rows[1:], strict=False))
