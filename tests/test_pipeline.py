import random

import pytest
from pyspark.sql import functions as F

from facetmill import cli
from facetmill.config import AggregationConfig
from facetmill.operators import clustering, components, graph, intervals, numbering, profile, resolve, similarity, tokens, wcc
from facetmill.plans import reports
from facetmill.plans.pipeline import Analysis

A = """//#if E|P
package x;
public class Caller extends Other implements Runnable {
//#if E
  private int speed;
  void run() { new Target().call(); speed = 1; }
//#endif
  void stop() { missing(); }
//#if P
  void only() { stop(); }
//#endif
}
//#endif
"""
B = "//#if E|P\npackage x;\npublic class Target { Target() { } void call() { } }\n//#endif\n"
BROKEN = "//#if E\nclass X { void run( {\n//#endif\n"


@pytest.fixture(scope="module")
def analysis(spark):
    return Analysis(spark.createDataFrame([("/a", A), ("/b", B), ("/c", BROKEN)], "path string, src string"))


def test_entities_merge_over_products(analysis):
    got = {(r.entity_type, r.qualified_name): (r.group_id, r.observed_products) for r in analysis.facts.entities.collect()}
    assert got[("CLASS", "x.Caller")] == ("G2", ["E", "P"]) and got[("METHOD", "x.Caller.run")] == ("G1", ["E"]) and got[("METHOD", "x.Caller.only")] == ("G3", ["P"])
    assert len(got) == 8 and sorted(r.entity_id for r in analysis.facts.entities.collect()) == [f"E{i}" for i in range(1, 9)]


def test_failures_and_counts(analysis):
    f = analysis.facts.failures.collect()
    assert [(r.file, r.product, r.line, r.extraction_skipped) for r in f] == [("/c", "E", 2, True)]
    assert tuple(analysis.facts.stats.first()) == (3, 6, 5)


def test_relations_resolve_by_name(analysis):
    got = {(r.relation_type, r.target_text): r.resolution_status for r in analysis.facts.relations.collect()}
    assert got[("METHOD_CALL", "call")] == got[("CONSTRUCTOR_CALL", "Target")] == got[("FIELD_REFERENCE", "speed")] == got[("METHOD_CALL", "stop")] == "RESOLVED_INTERNAL"
    assert got[("IMPLEMENTS", "Runnable")] == "RESOLVED_EXTERNAL" and got[("METHOD_CALL", "missing")] == got[("EXTENDS", "Other")] == got[("TYPE_REFERENCE", "int")] == "UNRESOLVED"


def test_edges_cross_files_and_are_numbered_by_text(analysis):
    e = analysis.graph.edges.collect()
    assert any(r.cross_file and r.relation_type == "METHOD_CALL" for r in e)
    key = lambda r: "|".join([r.source_file, str(r.source_line), r.relation_type, r.source_entity_id, r.target_entity_id])
    assert [r.edge_id for r in sorted(e, key=key)] == [f"D{i + 1}" for i in range(len(e))]


def test_candidates_cover_entities_and_blocks(analysis):
    c = analysis.candidates
    rows = {r.candidate_id: r for r in c.candidates.collect()}
    assert {r.group_id for r in rows.values()} == {"G1", "G2", "G3"}
    assert c.entities.count() == 8 and c.entities.select("entity_id").distinct().count() == 8
    assert all(r.isolated_entity_count == (r.classification_status == "ISOLATED_ENTITY") for r in rows.values())
    assert "BLOCK_ONLY" in {r.classification_status for r in rows.values()}  # the block that can't be parsed
    scopes = {r.dependency_scope for r in c.dependencies.collect()}
    assert "CROSS_SIGNATURE" in scopes


def test_aggregation_and_profiles(analysis):
    a = analysis.aggregation
    x = a.candidates.collect()
    assert sum(r.entity_count for r in x) == 8 and all(r.candidate_id.startswith("AFEC-G") for r in x)
    assert a.members.count() == analysis.candidates.candidates.count()
    p = {r.candidate_id: r for r in analysis.profiles.collect()}
    assert len(p) == len(x) and all(r.concept_evidence[-1] == profile.NOTE for r in p.values())
    ranks = analysis.importance.orderBy("candidate_id", "rank").collect()
    assert all(q.score >= r.score for r, q in zip(ranks, ranks[1:]) if r.candidate_id == q.candidate_id)


def test_reports_and_export(analysis, tmp_path, spark):
    said = []
    reports.show(spark, analysis, said.append)
    assert any("G1" in s for s in said)
    zero = {r.entity_type: r.n for r in reports.entities(analysis)["entities_by_type"].collect()}
    assert zero["INTERFACE"] == 0 and zero["CLASS"] == 2
    first = analysis.candidates.candidates.first().candidate_id
    assert reports.details(analysis, first)["candidate"].count() == 1 and reports.details(analysis, "AFEC-G1-01")["components"].count() >= 1
    with pytest.raises(ValueError, match="no such candidate"):
        reports.details(analysis, "FEC-none")
    analysis.export(str(tmp_path))
    assert len(list(tmp_path.glob("*.csv"))) == 17 and (tmp_path / "feature-evidence-report.txt").exists()
    text = "".join(p.read_text() for p in sorted((tmp_path / "unassigned-blocks.csv").glob("part-*")))
    assert text == "block_id,group_id,signature,file,branch_type,start_line,end_line,reason\n"


def test_without_directives_nothing_is_parsed(spark):
    a = Analysis(spark.createDataFrame([("/a", "class A { void m() {} }")], "path string, src string"))
    assert a.facts.entities.count() == 0 and tuple(a.facts.stats.first()) == (0, 0, 0)


def test_cli_rejects_bad_folders(tmp_path, capsys):
    assert cli.main(["../x", "--root", str(tmp_path)]) == 2 and "step up" in capsys.readouterr().err


# operators on rows made by hand


@pytest.mark.parametrize("few", [0, 12, 50_000])
def test_wcc_is_right_on_chains_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(wcc, "FEW", few)
    e = [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)] + [("z", f"m{i}") for i in range(10)] + [("q", "q"), ("m1", None)]
    got = {r.node: r.label for r in wcc.weakly_connected_components(spark.createDataFrame(e, "a string, b string"), "a", "b").collect()}
    assert {got[f"n{i:02}"] for i in range(41)} == {"n00"} and {got[f"m{i}"] for i in range(10)} | {got["z"]} == {"m0"} and "q" not in got


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("x"))
    got = [(r.x, r.n) for r in numbering.number(df, [F.col("x")], "n").collect()]
    assert sorted(got) == [(i, i + 1) for i in range(1000)]


def test_reasons_are_the_first_rule_broken(spark):
    rows = [("", False, "t", True, "UNRESOLVED", False), ("s", False, "t", True, "UNRESOLVED", False), ("s", True, None, False, "AMBIGUOUS", False), ("s", True, " ", False, "RESOLVED_INTERNAL", False), ("s", True, "t", False, "x", False), ("s", True, "t", True, "x", True), ("s", True, "t", True, "x", False)]
    df = spark.createDataFrame(rows, "s string, sf boolean, t string, tf boolean, st string, bad boolean")
    got = [r.w for r in df.select(graph.reason(*[F.col(c) for c in ("s", "sf", "t", "tf", "st", "bad")]).alias("w")).collect()]
    assert got == ["missing source entity", "source entity not found", "ambiguous target", "missing internal target", "target entity not found", "invalid constructor target type", None]


def test_weighted_jaccard(spark):
    f = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 1), ("c", "z", 2)], "k string, t string, n int")
    p = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("d", "e")], "a string, b string")
    got = {(r.a, r.b): r.lexical for r in similarity.weighted_jaccard(p, f, "k", "t", "n").collect()}
    assert got == {("a", "b"): 0.25, ("a", "c"): 0.0, ("a", "d"): 0.0, ("d", "e"): 0.0}


def test_greedy_clusters_reject_to_singletons():
    alike = {("a", "b"), ("a", "c"), ("c", "d")}
    assert clustering.greedy(["d", "c", "b", "a"], alike) == {"a": True, "b": True, "c": False, "d": False}
    assert clustering.greedy(["a", "b"], set()) == {"a": True, "b": False}


def test_rounds_decide_as_one_by_one(spark):
    """Parts of random density at once: a star, a clique, a path, missing pairs."""
    rng = random.Random(11)
    members, near = [], []
    for part, (n, p) in enumerate([(30, 0.5), (30, 0.95), (40, 0.1), (25, 1.0), (25, 0.0), (12, 0.7), (1, 0)]):
        ids = [f"p{part}-{i:02d}" for i in range(n)]
        members += [(f"p{part}", i) for i in ids]
        near += [(f"p{part}", a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if rng.random() < p or (part == 4 and k == 0)]
    m, e = spark.createDataFrame(members, "part string, component_id string"), spark.createDataFrame(near, "part string, a string, b string")
    got = {(r.part, r.component_id): r.accepted for r in clustering.by_rounds(m, e).collect()}
    want = {}
    for part in {x for x, _ in members}:
        want |= {(part, i): v for i, v in clustering.greedy([i for x, i in members if x == part], {(a, b) for x, a, b in near if x == part}).items()}
    assert got == want and sum(want.values()) > 40


def test_a_large_part_takes_many_tasks(spark):
    """100,000 members in one part: a star whose rim is cut in thirds; no task sees more than its share."""
    n = 100_000
    ids = spark.range(n).select(F.lit("p").alias("part"), F.format_string("m%06d", F.col("id")).alias("component_id"), "id")
    star = ids.where("id > 0").select("part", F.lit("m000000").alias("a"), F.col("component_id").alias("b"))
    rim = ids.where("id > 0 and id % 3 = 1").select("part", F.lit("m000001").alias("a"), F.col("component_id").alias("b")).where("a < b")
    got = clustering.by_rounds(ids.drop("id"), star.union(rim))
    kept = sorted(r.component_id for r in got.where("accepted").collect())
    assert kept == ["m000000", "m000001", "m000004"] and got.count() == n


def test_large_and_small_parts_agree(spark, monkeypatch):
    rng = random.Random(3)
    names = [f"c{i:02d}" for i in range(30)]
    pairs = spark.createDataFrame([(a, b, rng.random() < 0.1, rng.random()) for i, a in enumerate(names) for b in names[i + 1 :]], "a string, b string, merged boolean, combined double")
    nodes = spark.createDataFrame([("G", x) for x in names], "group_id string, component_id string")
    some = sorted(map(tuple, clustering.complete_link(nodes, pairs, 0.4).collect()))
    monkeypatch.setattr(clustering, "PART", 0)
    assert sorted(map(tuple, clustering.complete_link(nodes, pairs, 0.4).collect())) == some and any(r[3] for r in some)


def test_numbers_within_groups_over_many_ranges(spark):
    """Half of the rows in one group, null as a group, ties of groups across ranges."""
    rows = [("hot", i * 7919 % 5000) for i in range(5000)] + [(f"g{i % 40}", i) for i in range(4000)] + [(None, i) for i in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = numbering.number_within(spark.createDataFrame(rows, "g string, x int").repartition(5), ["g"], [F.col("x")], "n")
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for g in {r[0] for r in rows}:
        want += [(g, x, i + 1) for i, x in enumerate(sorted(v for k, v in rows if k == g))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pairs_are_dealt_to_even_cells(spark):
    n, block = 100_000, 4096
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id"))
    x, y = similarity.cells(rows, ["g"], "id", ["id"], block)
    per = x.groupBy("i", "j").agg(F.count("*").alias("n")).join(y.groupBy("i", "j").agg(F.count("*").alias("m")), ["i", "j"], "full").collect()
    m = -(-n // block)
    assert len(per) == m * (m + 1) // 2 and all(r.n <= block and r.m <= block for r in per)
    small = spark.createDataFrame([("g", i) for i in range(50)] + [("h", i) for i in range(7)], "g string, id int")
    x, y = similarity.cells(small, ["g"], "id", ["id"], 8)
    got = sorted((r.g, r.a, r.b) for r in x.join(y, ["g", "i", "j"]).where("_x < _y").collect())
    assert got == sorted((g, a, b) for g, k in (("g", 50), ("h", 7)) for a in range(k) for b in range(a + 1, k))
    assert sorted((r.group_id, r.a, r.b) for r in similarity.all_pairs(small, "g", "id", ["id"]).collect()) == got


def test_set_similarity_by_elements(spark):
    rng = random.Random(8)
    sets = {(k, i): {f"x{rng.randrange(9)}" for _ in range(rng.randrange(5))} for k in ("p", "q") for i in range(12)}
    long = spark.createDataFrame([("g", i, k, x) for (k, i), s in sets.items() for x in s], "g string, id int, kind string, x string")
    pairs = similarity.all_pairs(spark.createDataFrame([("g", i) for i in range(12)], "g string, id int"), "g", "id", ["id"])
    for r in similarity.set_jaccard(pairs, long, "g", "id", ["id"], ["p", "q"]).collect():
        for k in ("p", "q"):
            a, b = sets[k, r.a], sets[k, r.b]
            assert r[k] == (len(a & b) / len(a | b) if a and b else 0.0)


def test_innermost_interval_by_brute_force(spark):
    rng = random.Random(4)
    spans = [(rng.choice("fgh"), a, a + rng.choice([0, 1, 7, 15, 16, 17, 300, 5000, 40_000, -1])) for a in (rng.randrange(-50, 60_000) for _ in range(300))]
    i = spark.createDataFrame([(k, a, b, b - a, n) for n, (k, a, b) in enumerate(spans)], "k string, s int, e int, size int, n int")
    points = [(rng.choice("fgh"), rng.randrange(-60, 70_000)) for _ in range(500)] + [(k, x) for k, a, b in spans[:50] for x in (a, b, a - 1, b + 1)] + [(None, 3), ("f", None)]
    p = spark.createDataFrame(points, "k string, at int")
    rank = lambda n: (-(spans[n][2] - spans[n][1]), n)
    holds = lambda k, x: [n for n, (f, a, b) in enumerate(spans) if f == k and a <= x <= b]
    best = {(r.k, r["at"]): r.n for r in intervals.innermost(p, i, "k", "at", "s", "e", [-F.col("size"), F.col("n")], ["n"]).collect()}
    assert best == {(k, x): max(found, key=rank) for k, x in points if k and x is not None and (found := holds(k, x))}
    got = sorted((r.k, r["at"], r.n) for r in intervals.covering(p.where("at is not null and k is not null").distinct(), i, ["k"], "at", "s", "e").collect())
    assert got == sorted((k, x, n) for k, x in set(points) if k and x is not None for n in holds(k, x))


def test_a_hot_file_meets_its_blocks_by_even_keys(spark):
    """A million lines and 30,000 nested blocks of one file: rows joined stay near-linear and no key is hot."""
    n = 1_000_000
    lines = spark.range(n).select(F.lit("f").alias("k"), F.col("id").alias("at"))
    blocks = spark.range(10_000).select(F.lit("f").alias("k"), F.explode(F.array(*[F.struct((F.col("id") * 100 + d * 10).alias("s"), (F.col("id") * 100 + 99 - d * 10).alias("e"), F.lit(d).alias("d")) for d in range(3)])).alias("b")).select("k", "b.*")
    whole = spark.createDataFrame([("f", 0, n - 1, -1)], "k string, s long, e long, d int")
    keys = blocks.union(whole).select(F.explode(intervals.nodes_of(F.col("s"), F.col("e"))).alias("c"))
    assert keys.count() < 40 * 30_000
    hot = lines.select(F.explode(intervals.nodes_at(F.col("at"))).alias("c")).groupBy("c").count().agg(F.max("count")).first()[0]
    assert hot == intervals.WIDTH**intervals.LEVELS
    got = intervals.innermost(lines, blocks.union(whole), "k", "at", "s", "e", [F.col("d")], ["d"]).groupBy("d").count().collect()
    assert {r.d: r["count"] for r in got} == {0: 200_000, 1: 200_000, 2: 600_000}


def test_hot_names_match_as_others_do(spark, monkeypatch):
    """Names broadcast apart, all of them or the hottest two, against a plain look-up; null and empty names, a hot one without a match."""
    index = spark.createDataFrame([("M", "run", 1, "E1"), ("M", "get", 3, "E2"), ("T", "run", 1, "E3"), ("M", "a.b", 1, "E4")], "kind string, name string, n_ids long, id string")
    said = [("M", "run")] * 40 + [("M", "x.get")] * 30 + [("T", "run")] * 5 + [("M", "none")] * 20 + [("M", "a.b"), (None, "run"), ("M", None), ("M", ""), ("T", "q.run<X>[]")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "i int, k string, t string").repartition(3)

    def want(k, t):
        known = {("M", "run"): (1, "E1"), ("M", "get"): (3, None), ("T", "run"): (1, "E3"), ("M", "a.b"): (1, "E4")}
        full = (t or "").split("<")[0]
        return known.get((k, full)) or known.get((k, full.rpartition(".")[2])) or (0, None)

    for least, most in ((10_000, 4096), (1, 4096), (20, 2)):
        monkeypatch.setattr(resolve, "HOT", least)
        monkeypatch.setattr(resolve, "HOT_NAMES", most)
        got = {r.i: (r.m_n, r.m_id) for r in resolve.lookup(df, F.col("k"), F.col("t"), index, "m").collect()}
        assert got == {i: want(*x) for i, x in enumerate(said)}


def test_first_rows_are_bounded_before_the_shuffle(spark):
    rows = spark.range(0, 10_000, 1, 8).select((F.col("id") % 2).alias("g"), F.col("id").alias("x"))
    top = tokens.top_k(rows, ["g"], [F.desc("x")], 3)
    assert sorted((r.g, r.x, r["rank"]) for r in top.collect()) == [(0, 9994, 3), (0, 9996, 2), (0, 9998, 1), (1, 9995, 3), (1, 9997, 2), (1, 9999, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_labels(spark):
    df = spark.createDataFrame([([],), (["queue"],), (["queue", "item"],)], "t array<string>")
    got = [tuple(r) for r in df.select(clustering.label(F.col("t")), clustering.label_confidence(F.size("t"), F.lit(2)), profile.concept(F.col("t"))).collect()]
    assert got == [("", "UNLABELED", "Unlabeled implementation cluster"), ("Queue related code", "LOW", "Queue implementation cluster"), ("Queue item behavior", "MEDIUM", "Queue-item implementation cluster")]


def test_containment_is_by_prefix_and_file(spark):
    rows = [("c", "G", "f", "p.A", True), ("m", "G", "f", "p.A.m", False), ("n", "G", "f", "p.AB.m", False), ("o", "G", "g", "p.A.m", False)]
    df = spark.createDataFrame(rows, "id string, g string, f string, qn string, c boolean")
    assert [tuple(r) for r in components.containment(df, ["g", "f"], "qn", "id", F.col("c")).collect()] == [("c", "m")]


def test_strict_thresholds_prevent_merges(spark):
    m = spark.createDataFrame([("G", "a", "b", 0.6, ["lexical", "block"], 2)], "group_id string, a string, b string, combined double, support array<string>, support_count int")
    c = spark.createDataFrame([("a", "S", "ISOLATED_ENTITY"), ("b", "S", "STRUCTURALLY_CONNECTED")], "candidate_id string, signature string, classification_status string")
    why = lambda cfg: similarity.decisions(m, c, cfg).first().reason
    assert why(AggregationConfig()).startswith("threshold") and why(AggregationConfig(pairwise_merge_threshold=0.95)) == "combined score below threshold"
    assert why(AggregationConfig(aggregate_isolated_entities=False)) == "isolated aggregation disabled" and why(AggregationConfig(minimum_evidence_families=3)).startswith("insufficient")
