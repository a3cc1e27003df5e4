import pytest

from facetmill.sources import scan, sinks


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "assets/p/sub").mkdir(parents=True)
    (tmp_path / "assets/p/b").write_text("x\n")
    (tmp_path / "assets/p/sub/a c+%41").write_text("y")
    (tmp_path / "assets/p/_hidden").write_text("z")
    (tmp_path / "assets/p/bad").write_bytes(b"\xff\xfe")
    return tmp_path


def test_scan_reads_every_file(spark, tree):
    got = {r.path: r.src for r in scan.scan(spark, str(tree / "assets/p")).collect()}
    base = str(tree / "assets/p")
    assert got == {f"{base}/b": "x\n", f"{base}/sub/a c+%41": "y", f"{base}/_hidden": "z", f"{base}/bad": None}
    assert [r.path for r in scan.scan(spark, f"{base}/b").collect()] == [f"{base}/b"]
    assert [r.product for r in scan.unreadable(scan.scan(spark, base)).collect()] == ["<all>"]


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        scan.scan(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("sub", ["", "  ", "/abs", "../x", "p/../../y", "none", "p/b"])
def test_project_guard_rejects(tree, sub):
    with pytest.raises(ValueError):
        scan.resolve_project(tree, sub)


def test_project_guard_accepts(tree):
    got = scan.resolve_project(tree, " p ")
    assert got.path == tree / "assets/p" and got.display == "assets/p" and scan.base_directory_display("r") == "r/assets"


def test_csv_quotes_text_and_leaves_numbers_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("E1", "CLASS", 'a"b', None, "f", 1, 2, "G1", "A", ["A", "B"])], "entity_id string, entity_type string, simple_name string, qualified_name string, file string, start_line int, end_line int, group_id string, signature string, observed_products array<string>")
    sinks.write_csv(df, "dependency-nodes", str(tmp_path))
    text = "".join(p.read_text() for p in sorted((tmp_path / "dependency-nodes.csv").glob("part-*")))
    assert text == 'entity_id,entity_type,simple_name,qualified_name,file,start_line,end_line,group_id,signature,observed_products\n"E1","CLASS","a""b",,"f",1,2,"G1","A","A|B"\n'


def test_blocks_tsv(spark, tmp_path):
    from facetmill.operators import directives

    b = directives.extract(spark.createDataFrame([("f", "//#if A\n//#endif")], "path string, src string"))
    sinks.blocks_tsv(b, str(tmp_path / "b"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "b").glob("part-*")))
    assert text.split("\n")[:2] == ["file\tdirective\tstartLine\tendLine\tnestingDepth\tproductIds", "f\tif\t1\t1\t0\tA"]


def test_tree_lists_in_tasks_and_reports_failures(spark, tmp_path):
    from facetmill.sources import tree

    want = {}
    for i in range(60):
        d = tmp_path / "t" / f"d{i % 7}" / (".h" if i % 3 == 0 else "x") / f"_{i % 2}"
        d.mkdir(parents=True, exist_ok=True)
        (d / f"f{i}").write_bytes(b"" if i % 5 == 0 else b"\xff" if i % 11 == 0 else f"t{i}".encode())
        want[str(d / f"f{i}")] = None if i % 5 and i % 11 == 0 else "" if i % 5 == 0 else f"t{i}"
    (tmp_path / "t/loop").symlink_to(tmp_path / "t")
    assert {r.path: r.src for r in scan.scan(spark, str(tmp_path / "t")).collect()} == want
    for tasks in (1, 5, 200):
        reader = tree.TreeReader(f"file://{tmp_path}/t", tasks)
        parts = reader.partitions()
        assert len(parts) <= tasks and sorted(x for p in parts for b in reader.read(p) for x in b.column("path").to_pylist()) == sorted(want)
    gone = next(iter(tree.TreeReader(str(tmp_path), 1).read(tree.Part([], [f"{tmp_path}/none", str(tmp_path / "t/d0/.h/_0/f0")]))))
    assert gone.column("content").to_pylist() == [None, b""] and gone.column("error")[0].as_py().startswith("FileNotFoundError")


def test_lines_are_read_back_in_order_over_many_files(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.format_string("line %d", F.col("id") * 7919 % 5000).alias("value"))
        sinks.write_lines(rows, ["k"], f"{tmp_path}/l", "head")
        files = sorted((tmp_path / "l").glob("part-*"))
        assert len(files) > 4 and (tmp_path / "l/_SUCCESS").exists()
        assert "".join(f.read_text() for f in files).split("\n")[:-1] == ["head", *[f"line {i}" for i in range(5000)]]
        got = sorted((r.n, r.value) for r in sinks.read_lines(spark, f"{tmp_path}/l").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == list(enumerate(["head", *[f"line {i}" for i in range(5000)]]))
