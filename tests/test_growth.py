"""Steps whose cost grew faster than they need: what they read, shuffle and send to the driver."""

import random
from pathlib import Path

import pytest

from facetmill import queries
from facetmill.operators import graph, tokens, wcc

DATA = Path("/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("held", [3, 500_000])
def test_many_edges_among_few_vertices_are_joined_before_they_are_shuffled(spark, monkeypatch, held):
    rng = random.Random(2)
    pairs = [(f"v{g}-{rng.randrange(9)}", f"v{g}-{rng.randrange(9)}") for g in range(5) for _ in range(300)]
    label = {}
    for a, b in pairs:
        if a != b:
            x, y = sorted((label.setdefault(a, a), label.setdefault(b, b)))
            label = {k: x if v == y else v for k, v in label.items()}
    real, rows = wcc.shared.stored, []
    monkeypatch.setattr(wcc, "HELD", held)
    monkeypatch.setattr(wcc.shared, "stored", lambda df, name="step": (out := real(df, name)) and (rows.append(out.count()) or out))
    got = wcc.weakly_connected_components(spark.createDataFrame(pairs, "a string, b string").coalesce(1), "a", "b")
    assert {r.node: r.label for r in got.collect()} == label
    assert held == 3 or rows[0] == len(label) - 5


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_ends_that_are_names_are_read_once(spark):
    assert plan(queries.queries()["agg15_top5_endpoints"](spark, str(DATA))).count("lineitem.parquet") == 1


def test_evidence_is_neither_sorted_nor_shuffled(spark):
    from types import SimpleNamespace

    e = spark.createDataFrame([("c1", "e2", "METHOD", "f", 2, "readFile", None), ("c1", "e1", "CLASS", "f", 1, "Log", "p.Log")], "candidate_id string, entity_id string, entity_type string, file string, start_line int, simple_name string, qualified_name string")
    i = spark.createDataFrame([("c1", "e2", "e1", "METHOD_CALL", "f", 3)], "candidate_id string, source_entity_id string, target_entity_id string, relation_type string, source_file string, source_line int")
    made = tokens.evidence(SimpleNamespace(entities=e, internal=i), [])
    assert "Exchange" not in plan(made) and "Sort" not in plan(made)
    assert [r.token for r in made.orderBy("component_id", "pos").collect()] == ["log", "p", "log", "read", "file", "method", "call"]


def test_entities_are_not_sent_whole_through_the_driver(spark):
    e = spark.createDataFrame([(f"e{i}", "METHOD", f"f{i}", "G1", "A", "m", None, 1, 2, ["A"]) for i in range(3)], "entity_id string, entity_type string, file string, group_id string, signature string, simple_name string, qualified_name string, start_line int, end_line int, observed_products array<string>")
    ends = [("e0", "e1"), ("", "e1"), (None, "e1"), ("e0", " "), ("e0", None), ("e0", "e9"), ("e9", "e0")]
    r = spark.createDataFrame([(f"r{i}", s, t, "METHOD_CALL", "f0", 1, "b", ["A"], "UNRESOLVED") for i, (s, t) in enumerate(ends)], "relation_id string, source_entity_id string, target_entity_id string, relation_type string, file string, source_line int, block_id string, observed_products array<string>, resolution_status string")
    g = graph.build(e, r)
    assert "BroadcastHashJoin" not in plan(g.unresolved)
    why = {x.relation_id: x.failure_reason for x in g.unresolved.collect()}
    assert why == {"r1": "missing source entity", "r2": "missing source entity", "r3": "unresolved target", "r4": "unresolved target", "r5": "target entity not found", "r6": "source entity not found"}
    assert [(x.source_entity_id, x.target_entity_id) for x in g.edges.collect()] == [("e0", "e1")]
