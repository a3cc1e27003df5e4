"""Sources that one task reads are worked on by many."""

from pyspark.sql import functions as F

from facetmill.operators import components, directives, facts, intervals, projection


def test_sources_of_one_task_are_dealt(spark):
    files = spark.createDataFrame([(f"/f{i}", "//#if A\nclass C { }\n//#endif") for i in range(30)], "path string, src string").coalesce(1)
    universe = spark.createDataFrame([(["A"],)], "universe array<string>")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1
    for made in (directives.marks(files), projection.generate(files, universe), facts.parse(files, universe)):
        assert made.rdd.getNumPartitions() >= n
    assert directives.marks(files).count() == 60


def test_containers_and_members_of_one_name_are_dealt(spark):
    rows = [(f"c{i}", "h", "a", True) for i in range(23)] + [(f"m{i}", "h", "a/x/y", False) for i in range(31)] + [("c", "h", "a/x", True), ("n", None, "a/x", False), ("o", "h", None, False), ("p", "h", "a", False), ("q", "g", "a/x", False)]
    df = spark.createDataFrame(rows, "id string, host string, name string, is_dir boolean")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = components.containment(df, ["host"], "name", "id", F.col("is_dir"), "/", block=4)
        got = found.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(c, m) for c, h, n, d in rows if d for m, k, x, _ in rows if k == h and x and x.startswith(n + "/") and c != m]
    assert sorted((r.container, r.member) for r in got) == sorted(want)
    sizes = [sum(r.part == p for r in got) for p in {r.part for r in got}]
    assert len(sizes) > 1 and min(sizes) > len(got) / 10
    only = components.containment(df, ["host"], "name", "id", F.col("is_dir"), "/", ~F.col("is_dir"), 4)
    assert sorted(map(tuple, only.collect())) == sorted(x for x in want if x[1] != "c")


def test_nodes_of_intervals_carry_numbers_only(spark):
    """What is taken of an interval isn't copied to each of its nodes; ties of the rank go to the greatest of what is taken."""
    i = spark.createDataFrame([("f", s, s + w, w % 3 if w else None, f"b{s}-{w}") for s in range(-40, 900, 7) for w in (0, 3, 200, 5000)], "k string, s long, e long, d int, block string")
    p = spark.createDataFrame([("f", a) for a in range(-60, 6200, 13)] + [("g", 5), ("f", None)], "k string, at long")
    found = intervals.innermost(p, i, "k", "at", "s", "e", [F.col("d"), F.col("s")], ["block"])
    rank = lambda r: (r.d is not None, r.d or 0, r.s, r.block)
    rows, want = i.collect(), {}
    for x in p.collect():
        if inside := [r for r in rows if x.at is not None and r.k == x.k and r.s <= x.at <= r.e]:
            want[x.k, x.at] = max(inside, key=rank).block
    assert {(r.k, r.at): r.block for r in found.collect()} == want and len(want) > 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max(_b" in plan and "max(struct" not in plan and not any("Generate explode" in x and "_t#" in x for x in plan.splitlines())
    top = [x for x in plan.splitlines() if "max(_b" in x]
    assert all("named_struct" not in x for x in top)
