import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetmill.operators import directives, grouping, projection


def fold(found, last_line):
    """Blocks in pre-order from (line, directive, expression) in order (DIR-2 to DIR-5).

    A frame of the stack is an open ``if`` with its current branch; ``endif`` is a
    block of its own beside the branches. Orphans are ignored, open blocks end with
    the file, and a branch after ``else`` in name only has no products.
    """
    blocks, stack = [], []

    def add(kind: str, line: int, depth: int, raw: str, parent: int | None) -> dict:
        b = {"directive": kind, "start_line": line, "end_line": line, "depth": depth, "raw": raw, "ids": directives.ids_of(raw), "parent": parent, "kids": []}
        blocks.append(b)
        (blocks[parent]["kids"] if parent is not None else roots).append(len(blocks) - 1)
        return b

    def effective(raw: str, allowed: list[str] | None) -> str:
        return raw if allowed is None else "|".join(x for x in directives.ids_of(raw) if x in allowed)

    roots: list[int] = []
    for line, word, expression in found:
        if word == "if":
            parent = stack[-1]["branch"] if stack else None
            allowed = blocks[parent]["ids"] if parent is not None else None
            add("IF", line, len(stack), effective(expression, allowed), parent)
            stack.append({"depth": len(stack), "allowed": allowed, "parent": parent, "branch": len(blocks) - 1})
        elif stack:
            frame = stack[-1]
            open_ = blocks[frame["branch"]]
            open_["end_line"] = max(open_["start_line"], line - 1)
            if word == "endif":
                stack.pop()
                add("ENDIF", line, frame["depth"], "", frame["parent"])
            else:
                raw = effective(expression, frame["allowed"]) if word == "elif" else ""
                add(word.upper(), line, frame["depth"], raw, frame["parent"])
                frame["branch"] = len(blocks) - 1
    for frame in stack:
        open_ = blocks[frame["branch"]]
        open_["end_line"] = max(open_["start_line"], last_line)

    out: list[dict] = []

    def visit(k: int, parent: int | None) -> None:
        b = blocks[k]
        seq = len(out)
        out.append({c: b[c] for c in ("directive", "start_line", "end_line", "depth", "raw", "ids")} | {"seq": seq, "parent_seq": parent})
        for kid in b["kids"]:
            visit(kid, seq)

    for k in roots:
        visit(k, None)
    return out


def blocks(text):
    lines = text.split("\n")
    return fold([(i + 1, *d) for i, x in enumerate(lines) if (d := directives.recognise(x))], len(lines))


def brief(rows):
    return [(r["directive"], r["start_line"], r["end_line"], r["depth"], r["ids"]) for r in rows]


def test_branches():
    got = blocks("class Example {\n//#if P1 | P2\nint a;\n//#elif P3\nint b;\n//#else\nint c;\n//#endif\n}")
    assert brief(got) == [("IF", 2, 3, 0, ["P1", "P2"]), ("ELIF", 4, 5, 0, ["P3"]), ("ELSE", 6, 7, 0, []), ("ENDIF", 8, 8, 0, [])]


def test_nested_blocks_are_children_and_keep_only_outer_products():
    got = blocks("//#if Enterprise|Professional\n//#if Professional|Starter\n//#endif\n//#if Enterprise\n//#endif\n//#endif")
    assert [(r["raw"], r["parent_seq"], r["depth"]) for r in got] == [("Enterprise|Professional", None, 0), ("Professional", 0, 1), ("", 0, 1), ("Enterprise", 0, 1), ("", 0, 1), ("", None, 0)]


def test_orphans_are_ignored_and_open_blocks_end_with_the_file():
    assert blocks("//#elif A\n//#else\n//#endif\nx") == []
    assert brief(blocks("//#if A\nx\ny")) == [("IF", 1, 3, 0, ["A"])]


def test_blocks_in_else_have_no_products():
    assert [r["ids"] for r in blocks("//#if A\n//#else\n//#if A\n//#endif\n//#endif")] == [["A"], [], [], [], []]


@pytest.mark.parametrize("line, found", [("  //  #if A | B ", ("if", "A | B")), ("//#ifdef A", None), ("x //#if A", None), ("//#endif", ("endif", "")), ("//#else junk", ("else", "junk"))])
def test_recognise(line, found):
    assert directives.recognise(line) == found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["//#if A|B", "//#if B", "//#elif C", "//#else", "//#endif", "x"]), max_size=25))
def test_forest_properties(lines):
    rows = blocks("\n".join(lines))
    for r in rows:
        assert r["depth"] >= 0 and r["end_line"] >= r["start_line"]
        if r["parent_seq"] is not None:
            assert set(r["ids"]) <= set(rows[r["parent_seq"]]["ids"])
    text, n = projection.project("\n".join(lines), "B")
    assert n == len("\n".join(lines).split("\n")) and len(text.split("\n")) == n


SOURCE = "class A {\n//#if Professional\nint p;\n//#elif Enterprise\nint e;\n//#else\nint s;\n//#endif\n}\n"


@pytest.mark.parametrize("product, line", [("Professional", "int p;"), ("Enterprise", "int e;"), ("Starter", "int s;")])
def test_projection_keeps_one_branch_and_all_lines(product, line):
    text, n = projection.project(SOURCE, product)
    assert n == 9 and [x for x in text.split("\n") if x] == ["class A {", line, "}"]


def test_variant_code_is_restored():
    text, _ = projection.project("//#if A\n//@Override\n  //@void run() {\n//@}\n//#endif", "A")
    assert text.split("\n") == ["", "@Override", "  void run() {", "}", ""]
    assert projection.project("//#if A\n//@Override\n//#endif", "B")[0] == "\n\n"


def test_equal_projections_are_parsed_once():
    assert list(projection.variants("//#if A|B\nx\n//#endif", ["A", "B", "C"]).values()) == [["A", "B"], ["C"]]


def test_groups_are_numbered_in_array_order(spark):
    rows = [("z", "//#if Starter\n//#endif"), ("b", "\n//#if Professional|Enterprise\n//#endif"), ("a", "//#if Enterprise|Professional\n//#endif"), ("c", "//#if HomeBasic|Starter\n//#endif\n//#if Starter\n//#else\n//#endif")]
    b = directives.extract(spark.createDataFrame(rows, "path string, src string"))
    groups, members = grouping.group(b)
    assert sorted((r.group_id, r.signature, r.block_count) for r in groups.collect()) == [("G1", "Enterprise|Professional", 2), ("G2", "HomeBasic|Starter", 1), ("G3", "Starter", 2)]
    assert {r.directive for r in members.collect()} == {"IF"}
    assert grouping.universe(groups, "ids").first()[0] == ["Enterprise", "HomeBasic", "Professional", "Starter"]


def test_forest_by_windows_is_that_of_a_stack(spark):
    """Random scripts with orphans, open ends, repeats and odd spaces."""
    rng = random.Random(9)
    kinds = ["//#if A|B", "//#if B|A|B", " //\t#if C | B ", "//#if", "//#elif C", "//#elif A", "//#else", "//#else junk", "//#endif", "//#endif", "x", "", "x //#if A", "//#if A\u2028", "//#endif\u0085"]
    scripts = {f"/s{i}": "\n".join(rng.choice(kinds) for _ in range(rng.randrange(26))) + rng.choice(["", "\n"]) for i in range(300)}
    scripts |= {"/deep": "\n".join(["//#if A|B"] * 40 + ["//#if A"] + ["//#endif"] * 45), "/cr": "//#if A\r\n//#else\r//#endif"}
    got = {}
    for r in directives.extract(spark.createDataFrame(list(scripts.items()), "path string, src string")).collect():
        got.setdefault(r.file, []).append(r)
    for path, src in scripts.items():
        lines = re.split("\r\n|\n|\r", src)
        if lines[-1] == "":
            lines.pop()
        want = fold([(i + 1, *d) for i, x in enumerate(lines) if (d := directives.recognise(x))], len(lines))
        mine = sorted(got.get(path, []), key=lambda r: r.seq)
        assert [tuple(r[c] for c in ("seq", "directive", "start_line", "end_line", "depth", "raw", "ids", "parent_seq")) for r in mine] == [tuple(w[c] for c in ("seq", "directive", "start_line", "end_line", "depth", "raw", "ids", "parent_seq")) for w in want], src


def test_no_directives_no_blocks(spark):
    assert directives.extract(spark.createDataFrame([("a", "class A {}")], "path string, src string")).count() == 0


def test_bytes_that_are_not_text_end_the_run(spark):
    from facetmill.sources import scan

    with pytest.raises(Exception, match="not UTF-8"):
        scan.lines(spark.createDataFrame([("a", None)], "path string, src string")).collect()
