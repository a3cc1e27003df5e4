from facetmill.streaming import blocks


def test_new_files_are_read_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a b").write_text("//#if A|B\nx\n//#elif C\n//#endif\n")
    blocks.blocks_to(spark, src, out, ck).awaitTermination()
    (tmp_path / "src/c").write_text("//#if D\n")
    blocks.blocks_to(spark, src, out, ck).awaitTermination()
    got = sorted((r.file.rpartition("/")[2], r.directive, r.start_line, r.end_line) for r in spark.read.parquet(out).collect())
    assert got == [("a b", "ELIF", 3, 3), ("a b", "ENDIF", 4, 4), ("a b", "IF", 1, 2), ("c", "IF", 1, 1)]
