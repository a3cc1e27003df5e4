"""Queries over whole tables: against their SQL, and components against brute force."""

import random
from pathlib import Path

import pytest

from facetmill import project_queries, queries
from facetmill.operators import clustering

DATA = Path("/root/testdata/sf0.001")
NAMES = sorted([*project_queries.ORACLE, "gra5_agg14_win7_importance", "win4_text_key_numbers", "agg15_top5_endpoints", "join16_join17_sim1_2_3_4_5_measures", "sim6_sim7_fil7_decisions", "join12_containment"])


def plain(rows):
    return sorted(tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r) for r in rows)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_whole_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in NAMES:
        if sql := queries.oracle_sql().get(name):
            got = queries.queries()[name](spark, str(DATA))
            want = db.execute(sql)
            cols = [d[0] for d in want.description]
            assert plain(got.select(*cols).collect()) == plain(want.fetchall()), name


def test_whole_components(spark, tmp_path):
    data = [(p, p % 7 if p < 40 else 10 + p % 3, float(p), p % 4, 0.01) for p in range(60)] + [(1, 3, 1.0, 2, 0.0)]
    spark.createDataFrame(data, "l_partkey long, l_suppkey long, l_quantity double, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    label = {}
    for p, s, *_ in data:
        for x in (f"P{p}", f"S{s}"):
            label.setdefault(x, x)
        a, b = label[f"P{p}"], label[f"S{s}"]
        label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    least = {}
    for k, v in label.items():
        least[v] = min(least.get(v, k), k)
    number = {v: i + 1 for i, v in enumerate(sorted(set(least.values())))}
    got = queries.queries()["gra2_gra3_win5_components"](spark, str(tmp_path)).collect()
    assert sorted((r.node, r.candidate_id) for r in got) == sorted((k, f"FEC-G1-{number[least[v]]:02d}") for k, v in label.items())


def test_clusters_by_brute_force(spark):
    """Random pairs: components of merged pairs, then members in order of id while all pairs and their mean reach the threshold."""
    rng = random.Random(5)
    names = [f"c{i:02d}" for i in range(28)]
    pairs = [(a, b, rng.random() < 0.12, round(rng.random(), 3)) for i, a in enumerate(names) for b in names[i + 1 :]]
    label = {n: n for n in names}
    for a, b, merged, _ in pairs:
        if merged:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
    score = {frozenset(p[:2]): p[3] for p in pairs}
    want = {}
    for part in set(label.values()):
        inside, alone = [], 0
        for n in sorted(k for k, v in label.items() if v == part):
            tried = [*inside, n]
            all_ = [score[frozenset((tried[i], tried[j]))] for i in range(len(tried)) for j in range(i)]
            if all_ and (min(all_) < 0.3 or sum(all_) / len(all_) < 0.3):
                want[n], alone = (part, "alone", n), alone + 1
            else:
                inside.append(n)
                want[n] = (part, "together", "")
    nodes = spark.createDataFrame([("G", n) for n in names], "group_id string, component_id string")
    df = spark.createDataFrame(pairs, "a string, b string, merged boolean, combined double")
    got = clustering.complete_link(nodes, df, 0.3).collect()
    assert {r.component_id: (r.part, "alone" if r.alone else "together", r.component_id if r.alone else "") for r in got} == want
    assert len({v for v in want.values()}) > 3
