"""Pairs by twins: components that no measure tells apart are compared once, and no pair is lost."""

import random

import pytest

from facetmill.config import AggregationConfig
from facetmill.operators import clustering, similarity, tokens


def plain(pairs, columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in pairs.select(*columns).collect())


@pytest.mark.parametrize(("aggregate_isolated", "threshold"), [(True, 0.42), (False, 0.6)])
def test_pairs_and_clusters_by_twins(spark, aggregate_isolated, threshold):
    rng = random.Random(11)
    config = AggregationConfig(aggregate_isolated_entities=aggregate_isolated)
    ids = [f"c{i:02d}" for i in range(44)]
    kind_of = {c: rng.randrange(6) for c in ids[:40]}
    group = {c: "G1" if kind_of.get(c, 0) % 2 == 0 else "G2" for c in ids}
    held, edges = {}, set()
    for c, k in kind_of.items():
        held[c] = {("packages", f"p{k // 3}"): 1, ("files", f"f{k // 2}"): 1, ("files", "f"): 1, ("block_ids", f"b{k % 3}"): 1, ("tokens", f"t{k // 2}"): 1 + k % 2, ("tokens", "u"): 2}
        if k == 4:
            edges.add((c, ids[40]))
            held[c][("neighbors", "n")] = 1
    held[ids[40]], held[ids[41]] = {("tokens", "u"): 1, ("tokens", "only"): 7}, {("tokens", "u"): 1}
    status = {c: "ISOLATED_ENTITY" if kind_of.get(c, 1) == 0 else "STRUCTURALLY_CONNECTED" for c in ids}
    line = {c: rng.randrange(5) for c in ids}
    c = spark.createDataFrame([(group[x], x, "S", status[x], ["f"], line[x]) for x in ids], "group_id string, candidate_id string, signature string, classification_status string, files array<string>, min_line int")
    e = spark.createDataFrame([(x, k, v, n) for x, of in held.items() for (k, v), n in of.items()], "component_id string, kind string, x string, n long")
    out = spark.createDataFrame(sorted(edges), "candidate_id string, other_candidate_id string")

    def measure(a, b, kind):
        x, y = ({k: n for k, n in held.get(s, {}).items() if k[0] == kind} for s in (a, b))
        low = sum(min(n, y[k]) for k, n in x.items() if k in y)
        return low / (sum(x.values()) + sum(y.values()) - low) if low else 0.0

    want = []
    for g in ("G1", "G2"):
        placed = sorted((x for x in ids if group[x] == g), key=lambda x: (line[x], x))
        for i, a in enumerate(placed):
            for b in placed[i + 1 :]:
                m = {k: measure(a, b, k) for k in [*tokens.KINDS, "tokens"]}
                want.append((g, a, b, round(m["tokens"], 9), round((m["packages"] + m["classes"] + m["files"]) / 3, 9), m["neighbors"], float((a, b) in edges or (b, a) in edges), round(m["block_ids"], 9)))

    like = similarity.twins(c, e, out).cache()
    judged = similarity.judged(similarity.similarities(like, e, out, config), like.where("candidate_id = twin"), config).cache()
    pairs = similarity.expanded(judged, like, 3).cache()
    assert plain(pairs, ["group_id", "a", "b", "lexical", "context", "neighborhood", "direct", "block"]) == sorted(want)
    assert judged.count() < len(want) / 4

    flat = pairs.selectExpr("a", "b", "decision = 'MERGED' as merged", "combined")
    one_by_one = clustering.complete_link(c.selectExpr("group_id", "candidate_id as component_id"), flat, threshold)
    by_twins = clustering.of_twins(like, judged.selectExpr("a", "b", "decision = 'MERGED' as merged", "combined"), threshold)
    columns = ["group_id", "component_id", "part", "alone"]
    assert plain(by_twins, columns) == plain(one_by_one, columns)


def test_what_pairs_show_is_worked_out_before_they_are_made(spark):
    """Rows of the reports on pairs copy rounded values and texts; only the names of two components differ."""
    from pathlib import Path

    from facetmill import project_queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    made = project_queries.QUERIES["snk13_snk14_agg11_gra6_sim1_to_sim7_similarities_and_decisions"](spark, str(data))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate explode(_y") < plan.index("round(")


def test_lines_of_the_detail_view_are_numbered_without_their_texts(spark, monkeypatch):
    from pathlib import Path

    from facetmill import project_queries
    from facetmill.plans import reports

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    real, texts = reports.number, []
    monkeypatch.setattr(reports, "number", lambda df, order, name: texts.append(df.where("section = 9").agg({"line": "max"}).first()[0]) or real(df, order, name))
    a = project_queries.project(spark, str(data))
    got = [r.line for r in reports.detail_text(a, "AFEC-G2-01").orderBy("n").collect()]
    said = [x for x in got if " score=" in x]
    assert len(said) == a.aggregation.members.where("candidate_id = 'AFEC-G2-01'").count() * (a.aggregation.members.where("candidate_id = 'AFEC-G2-01'").count() - 1) // 2
    assert got[got.index("Merge decisions:") + 1] == said[0] and " reason=threshold" in said[0] and texts == [""]


def test_lines_of_merged_pairs_get_their_places_without_being_stored(spark, monkeypatch):
    """Names are in another order than places; some pairs of twins aren't merged, and some components are of another cluster."""
    from types import SimpleNamespace

    from facetmill import shared
    from facetmill.plans import reports

    rng = random.Random(5)
    names = [f"c{i}" for i in range(1, 131)]
    twin_of = {c: rng.randrange(5) for c in names}
    first = {k: min(c for c in names if twin_of[c] == k) for k in range(5)}
    place = dict(zip(rng.sample(names, len(names)), range(1, len(names) + 1), strict=True))
    score = {(j, k): rng.choice([0.25, 0.5005, 0.75]) for k in range(5) for j in range(k + 1)}
    like = spark.createDataFrame([("G1", c, first[twin_of[c]], place[c]) for c in names], "group_id string, candidate_id string, twin string, n long")
    judged = spark.createDataFrame([("G1", first[j], first[k], x, ["lexical"] if x < 0.7 else [], "MERGED" if x > 0.3 else "NOT_MERGED", "r") for (j, k), x in score.items()], "group_id string, a string, b string, combined double, support array<string>, decision string, reason string")
    mine = [c for c in names if c != "c7"]
    e = spark.createDataFrame([(c, f"e{c}", "Log", "p.Log", "f", 1, 2) for c in names[:3]], "candidate_id string, entity_id string, simple_name string, qualified_name string, file string, start_line int, end_line int")
    none = spark.createDataFrame([("other",)], "candidate_id string")
    found = spark.createDataFrame([("AFEC-G1-01", "G1", "", "LOW", "LOW", ["c1"], ["log"])], "candidate_id string, group_id string, suggested_label string, label_confidence string, candidate_confidence string, component_ids array<string>, representative_tokens array<string>")
    members = spark.createDataFrame([("AFEC-G1-01", c) for c in mine], "candidate_id string, component_id string")
    a = SimpleNamespace(candidates=SimpleNamespace(entities=e, blocks=none, internal=none), aggregation=SimpleNamespace(candidates=found, members=members, like=like, judged=judged, incoming=none, outgoing=none), profiles=none)

    want = []
    for x, y in sorted((x, y) for x in mine for y in mine if place[x] < place[y]):
        s = score[tuple(sorted((twin_of[x], twin_of[y])))]
        if s > 0.3:
            want.append(f"- {x} + {y} score={'0.501' if s == 0.5005 else '0.750'} evidence={'[lexical]' if s < 0.7 else '[]'} reason=r")
    real, rows = shared.stored, []
    monkeypatch.setattr(shared, "stored", lambda df, *of: (out := real(df, *of)) and (rows.append(out.count()) or out))
    monkeypatch.setattr(similarity, "BLOCK", 4)
    monkeypatch.setattr(similarity, "NAMES", 32, raising=False)
    got = [tuple(r) for r in reports.detail_text(a, "AFEC-G1-01").orderBy("n").collect()]
    assert [n for n, _ in got] == list(range(1, len(got) + 1))
    at = [line for _, line in got].index("Merge decisions:") + 1
    assert [line for _, line in got[at:]] == [*want, "Incoming dependencies: 0", "Outgoing dependencies: 0"]
    assert len(want) > 3000 and max(rows) < len(want) / 4


def test_reports_on_pairs_make_no_clusters_and_measure_pairs_once(spark, monkeypatch):
    from pathlib import Path

    from facetmill import project_queries, shared

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("no tables")
    real, names = shared.stored, []
    monkeypatch.setattr(shared, "stored", lambda df, name="step", *of: names.append(name) or real(df, name, *of))
    monkeypatch.setattr(project_queries, "_MADE", {})
    for q in ("snk13_snk14_agg11_gra6_sim1_to_sim7_similarities_and_decisions", "snk13_snk14_sim7_decisions_by_strict_rules"):
        project_queries.QUERIES[q](spark, str(data))
    assert names.count("evidence") == names.count("twins") == 1 and not {"clusters", "aggregated"} & set(names)

    config = project_queries.STRICT
    a = project_queries.project(spark, str(data), config)
    alone = clustering.compare(a.candidates, config)
    assert set(a.compared.judged.select("threshold", "decision").collect()) == set(alone.judged.select("threshold", "decision").collect())
    assert plain(a.compared.judged.drop("support"), a.compared.judged.drop("support").columns) == plain(alone.judged.drop("support"), alone.judged.drop("support").columns)
