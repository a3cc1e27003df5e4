import pytest

from facetmill import javaparse as jp


def facts(source):
    return jp.facts(jp.parse(source))


def of(rows, kind):
    return [r["target_text"] for r in rows if r["relation_type"] == kind]


RICH = """package a.b;
import java.util.*;
@Deprecated class Service<T extends Base & Api> extends Base<Map<String, List<int[]>>> implements Api, Runnable {
  private final int a = 1, b[] = {1, 2};
  Service(int x, List<String>... ys) throws IOException { super(x); this.a = x; }
  Service() { this(1); }
  @Override public <R> R run(final Map<?, ? extends R> z) {
    int y = (int) 3.0 >>> 2; y >>= 1;
    if (a < b.length && a > 3) foo(a).bar();
    Runnable r = () -> { helper(); };
    new Thread() { public void inner() { a++; } }.start();
    class Local { void lm() {} }
    return (R) x.y.z[3].w;
  }
  interface Api2 { void m(); default int n() { return 1; } }
  enum E { A, B(3) { void q() {} }; int f; E() {} }
}
"""


def test_entities():
    got = {(e["entity_type"], e["qualified_name"], e["params"]) for e in facts(RICH)[0]}
    assert got == {
        ("CLASS", "a.b.Service", ""), ("INTERFACE", "a.b.Service.Api2", ""), ("FIELD", "a.b.Service.a", ""), ("FIELD", "a.b.Service.b", ""), ("FIELD", "a.b.Service.f", ""),
        ("CONSTRUCTOR", "a.b.Service.Service", "int,List<>"), ("CONSTRUCTOR", "a.b.Service.Service", ""), ("CONSTRUCTOR", "a.b.Service.E", ""),
        ("METHOD", "a.b.Service.run", "Map<>"), ("METHOD", "a.b.Service.inner.run", ""), ("METHOD", "a.b.Service.Local.lm.run", ""), ("METHOD", "a.b.Service.Api2.m", ""), ("METHOD", "a.b.Service.Api2.n", ""), ("METHOD", "a.b.Service.q", ""),
    }


def test_relations():
    r = facts(RICH)[1]
    assert of(r, "EXTENDS") == ["Base<Map<String, List<int[]>>>"] and of(r, "IMPLEMENTS") == ["Api", "Runnable"]
    assert of(r, "CONSTRUCTOR_CALL") == ["Thread", "super", "this"] and set(of(r, "METHOD_CALL")) == {"bar", "foo", "helper", "start"}
    types = set(of(r, "TYPE_REFERENCE"))
    assert {"int", "int[]", "T extends Base & Api", "Map<?, ? extends R>", "?", "? extends R", "R", "Runnable", "IOException"} <= types and "void" not in types


def test_field_references():
    source = "class U extends Base { int value; void m(int parameter) { int local = value; local = parameter; inherited = external.other; valueMethod(); } }"
    r = [x for x in facts(source)[1] if x["relation_type"] == "FIELD_REFERENCE"]
    assert [(x["target_text"], x["target_key"] is not None) for x in r] == [("other", False), ("value", True)]


def test_source_of_a_relation_is_the_nearest_declaration():
    r = {x["target_text"]: x["source_key"][:3:2] for x in facts("class A { int f = init(); void m() { call(); } { block(); } }")[1] if x["relation_type"] == "METHOD_CALL"}
    assert r == {"init": ("FIELD", "A.f"), "call": ("METHOD", "A.m"), "block": ("CLASS", "A")}


@pytest.mark.parametrize("source", ["class A { void run( { } }", "class A {", "x", 'class A { String s = "a; }', "class { }"])
def test_failures_have_a_line(source):
    with pytest.raises(jp.Failure) as e:
        jp.parse(source)
    assert e.value.line >= 1 and e.value.message


@pytest.mark.parametrize("body", [
    "int k = switch (a) { case 1, 2 -> 3; default -> { yield 4; } };", "switch (a) { case X: break; default: return; }", "for (var x : y) for (int i = 0, j = 1; i < 3; i++, j--) ;", "Object o = (Runnable & Foo) () -> {};",
    "Class<?> c = int[].class; String.class.getName();", "List<String>[] q = new List[3]; int[][] z = {{1}, {2}};", "try (Reader q = open(); w) { } catch (A | B e) { } finally { }", "l: while (true) { do { continue l; } while (x instanceof String t && t.isEmpty()); }",
    "outer.new Inner(3); Outer.this.x(); a = b ? c : d; f = String::valueOf; g = int[]::new;", "x = (Foo) y; x = (foo) - 3; this.<String>gen(1); a >>>= 2; b = a >> 1 >= 3;", 'String t = """\n a "quoted" b\n """; char c = \'\\\'\';', "assert a : b; synchronized (x) { throw y; }",
    "BiFunction<A, B, C> g = (x, y) -> x + y; F h = (int x, final B y) -> { return x; };", "record P(int x) { P { } } enum E { A } interface I { }", "a[i]++; --b; c = d[e][f].g(h)[0];",
])
def test_statements_parse(body):
    jp.parse("class A { void m() { " + body + " } }")
