"""Parser for Java 17 compilation units: tokens, recursive descent, and the facts of a unit.

Pure Python without Spark. ``facts`` gives rows for declared entities and for
relations (types, calls, inheritance, field accesses), each with the key of the
nearest enclosing declaration.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

PRIMITIVES = {"boolean", "byte", "char", "double", "float", "int", "long", "short"}
MODIFIERS = {"abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized", "transient", "volatile"}
KEYWORDS = (
    PRIMITIVES
    | (MODIFIERS - {"default"})
    | set("assert break case catch class const continue default do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try void while true false null _".split())
)
BINARY = {"||", "&&", "|", "^", "&", "==", "!=", "<", ">", "<=", ">=", "<<", "+", "-", "*", "/", "%"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="}
TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n\r]*|/\*.*?\*/)
|(?P<text>\"\"\"(?:\\.|[^\\])*?\"\"\"|"(?:\\.|[^"\\\n\r])*"|'(?:\\.|[^'\\\n\r])+')
|(?P<number>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)
|(?P<name>[^\W\d][\w$]*|\$[\w$]*)
|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~?:;,.(){}\[\]<>=@])""",
    re.X | re.S,
)


class Failure(Exception):
    """A unit that can't be parsed, with the line where it fails."""

    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line, self.message = line, message


class Node:
    """A syntax node: kind, name, first and last line, children in order."""

    __slots__ = ("kind", "name", "line", "end", "kids", "up", "more")

    def __init__(self, kind: str, line: int, end: int = 0, name: str = "", kids: list | None = None, **more):
        self.kind, self.line, self.end, self.name, self.kids, self.up, self.more = kind, line, end or line, name, kids or [], None, more

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.kids))

    def above(self, *kinds: str) -> Node | None:
        """The nearest ancestor of one of these kinds."""
        n = self.up
        while n is not None and n.kind not in kinds:
            n = n.up
        return n


def tokens(source: str) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise Failure(line, f"unexpected character {source[at]!r}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    out.append(("end", "", line))
    return out


class Parser:
    """Recursive descent with backtracking where types and expressions look alike."""

    def __init__(self, source: str):
        self.t = tokens(source)
        self.i = 0

    # tokens

    @property
    def text(self) -> str:
        return self.t[self.i][1] if self.t[self.i][0] != "text" else ""

    @property
    def line(self) -> int:
        return self.t[self.i][2]

    def peek(self, n: int = 1) -> str:
        k = min(self.i + n, len(self.t) - 1)
        return self.t[k][1] if self.t[k][0] != "text" else ""

    def last(self) -> int:
        """The line where the token before ends."""
        kind, text, line = self.t[max(self.i - 1, 0)]
        return line + text.count("\n")

    def fail(self, wanted: str = "") -> None:
        raise Failure(self.line, f"unexpected {self.t[self.i][1] or 'end of file'!r}" + (f", expected {wanted}" if wanted else ""))

    def accept(self, *texts: str) -> bool:
        if self.text in texts:
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            self.fail(repr(text))

    def is_name(self, n: int = 0) -> bool:
        kind, text, _ = self.t[min(self.i + n, len(self.t) - 1)]
        return kind == "name" and text not in KEYWORDS

    def name(self) -> str:
        if not self.is_name():
            self.fail("a name")
        self.i += 1
        return self.t[self.i - 1][1]

    def attempt(self, rule, *args):
        """The rule's node, or None and no token used."""
        at = self.i
        try:
            return rule(*args)
        except Failure:
            self.i = at
            return None

    # types

    def annotations(self) -> list[Node]:
        out = []
        while self.text == "@" and self.peek() != "interface":
            line = self.line
            self.i += 1
            self.name()
            while self.text == "." and self.is_name(1):
                self.i += 1
                self.name()
            kids = []
            if self.accept("("):
                while self.text != ")":
                    if self.is_name() and self.peek() == "=":
                        self.i += 2
                    kids.append(self.element())
                    if not self.accept(","):
                        break
                self.expect(")")
            out.append(Node("annotation", line, self.last(), kids=kids))
        return out

    def element(self) -> Node:
        if self.text == "@":
            return self.annotations()[0]
        if self.text == "{":
            return self.array_init(self.element)
        return self.ternary()

    def type_args(self) -> list[Node]:
        self.expect("<")
        out = []
        while self.text != ">":
            line = self.line
            self.annotations()
            if self.accept("?"):
                kids, text = [], "?"
                if self.text in ("extends", "super"):
                    text += f" {self.text} "
                    self.i += 1
                    kids = [self.type()]
                    text += kids[0].name
                out.append(Node("type", line, self.last(), text, kids, form="wildcard"))
            else:
                out.append(self.type())
            if not self.accept(","):
                break
        self.expect(">")
        return out

    def class_type(self) -> Node:
        line, node = self.line, None
        while True:
            notes = self.annotations()
            own = self.name()
            args = self.type_args() if self.text == "<" else None
            text = own + (f"<{', '.join(a.name for a in args)}>" if args is not None else "")
            kids = ([node] if node else []) + notes + (args or [])
            node = Node("type", line, self.last(), f"{node.name}.{text}" if node else text, kids, form="class")
            if not (self.text == "." and (self.is_name(1) or self.peek() == "@")):
                return node
            self.i += 1

    def type(self, dims: bool = True) -> Node:
        line = self.line
        self.annotations()
        if self.text in PRIMITIVES:
            node = Node("type", line, name=self.text, form="primitive")
            self.i += 1
        else:
            node = self.class_type()
        return self.dims(node) if dims else node

    def dims(self, node: Node) -> Node:
        while True:
            at = self.i
            self.annotations()
            if self.text == "[" and self.peek() == "]":
                self.i += 2
                node = Node("type", node.line, self.last(), node.name + "[]", [node], form="array")
            else:
                self.i = at
                return node

    def result(self) -> Node:
        if self.text == "void":
            self.i += 1
            return Node("type", self.t[self.i - 1][2], name="void", form="void")
        return self.type()

    def type_params(self) -> list[Node]:
        out = []
        if self.accept("<"):
            while self.text != ">":
                line = self.line
                self.annotations()
                own, kids = self.name(), []
                if self.accept("extends"):
                    kids.append(self.type())
                    while self.accept("&"):
                        kids.append(self.type())
                text = own + (" extends " + " & ".join(k.name for k in kids) if kids else "")
                out.append(Node("type", line, self.last(), text, kids, form="parameter"))
                if not self.accept(","):
                    break
            self.expect(">")
        return out

    # declarations

    def unit(self) -> Node:
        package, kids = "", []
        at = self.i
        self.annotations()
        if self.accept("package"):
            package = self.qualified()
            self.expect(";")
        else:
            self.i = at
        while self.text in ("import", ";"):
            if self.accept(";"):
                continue
            self.i += 1
            self.accept("static")
            self.qualified()
            if self.accept("."):
                self.expect("*")
            self.expect(";")
        while self.t[self.i][0] != "end":
            if not self.accept(";"):
                kids.append(self.type_declaration())
        root = Node("unit", 1, self.last(), package, kids)
        for n in root.walk():
            for k in n.kids:
                k.up = n
        return root

    def qualified(self) -> str:
        out = self.name()
        while self.text == "." and self.is_name(1):
            self.i += 1
            out += "." + self.name()
        return out

    def modifiers(self) -> list[Node]:
        out = []
        while True:
            if self.text == "@" and self.peek() != "interface":
                out += self.annotations()
            elif self.text in MODIFIERS and not (self.text == "default" and self.peek() in (":", "->")):
                if self.text in ("static", "default") and self.peek() == "{":
                    return out
                self.i += 1
            elif self.text in ("sealed",) and (self.peek() in MODIFIERS or self.peek() in ("class", "interface", "sealed")):
                self.i += 1
            elif self.text == "non" and self.peek() == "-" and self.peek(2) == "sealed":
                self.i += 3
            else:
                return out

    def starts_type(self) -> bool:
        return self.text in ("class", "interface", "enum") or (self.text == "@" and self.peek() == "interface") or (self.text == "record" and self.is_name(1) and self.peek(2) in ("(", "<"))

    def type_declaration(self) -> Node:
        line = self.line
        notes = self.modifiers()
        if not self.starts_type():
            self.fail("a type declaration")
        return self.declared_type(line, notes)

    def declared_type(self, line: int, notes: list[Node]) -> Node:
        if self.accept("@"):
            self.expect("interface")
            own = self.name()
            return self.body(Node("annotation_type", line, name=own, kids=notes), own)
        word = self.text
        self.i += 1
        own = self.name()
        kids = notes + self.type_params()
        node = Node({"class": "class", "interface": "interface"}.get(word, word), line, name=own, kids=kids, extends=[], implements=[])
        if word == "record":
            self.expect("(")
            node.kids += self.parameters(")")
        while self.text in ("extends", "implements", "permits"):
            clause = self.text
            self.i += 1
            found = [self.type()]
            while self.accept(","):
                found.append(self.type())
            node.kids += found
            if clause != "permits" and word in ("class", "interface"):
                node.more[clause] += found
        return self.body(node, own)

    def body(self, node: Node, own: str) -> Node:
        self.expect("{")
        if node.kind == "enum":
            while self.text not in (";", "}"):
                line = self.line
                kids = self.annotations()
                constant = self.name()
                if self.accept("("):
                    kids += self.arguments()
                inner = Node("constant", line, name=constant, kids=kids)
                if self.text == "{":
                    self.body(inner, "")
                inner.end = self.last()
                node.kids.append(inner)
                if not self.accept(","):
                    break
            if self.text != "}":
                self.expect(";")
        while not self.accept("}"):
            if self.t[self.i][0] == "end":
                self.fail("'}'")
            if not self.accept(";"):
                node.kids.append(self.member(own, node.kind))
        node.end = self.last()
        return node

    def member(self, own: str, kind: str) -> Node:
        line = self.line
        if self.text == "{" or (self.text == "static" and self.peek() == "{"):
            self.accept("static")
            b = self.block()
            return Node("initializer", line, self.last(), kids=[b])
        notes = self.modifiers()
        if self.starts_type():
            return self.declared_type(line, notes)
        params = self.type_params()
        notes += self.annotations()
        if self.is_name() and self.text == own and self.peek() in ("(", "{"):
            self.i += 1
            node = Node("constructor" if self.text == "(" else "compact", line, name=own, kids=notes + params, params=[])
            if self.accept("("):
                node.more["params"] = self.parameters(")")
                node.kids += node.more["params"]
            self.throws(node)
            node.kids.append(self.block())
            node.end = self.last()
            return node
        of = self.result()
        if self.is_name() and self.peek() == "(":
            own = self.name()
            self.i += 1
            node = Node("annotation_member" if kind == "annotation_type" else "method", line, name=own, kids=notes + params)
            node.more["params"] = self.parameters(")")
            of = self.dims(of)
            node.kids += [of, *node.more["params"]]
            self.throws(node)
            if self.accept("default"):
                node.kids.append(self.element())
            if self.text == "{":
                node.kids.append(self.block())
            else:
                self.expect(";")
            node.end = self.last()
            return node
        node = Node("field", line, kids=notes + self.declarators(of))
        self.expect(";")
        node.end = self.last()
        return node

    def throws(self, node: Node) -> None:
        if self.accept("throws"):
            node.kids.append(self.type())
            while self.accept(","):
                node.kids.append(self.type())

    def declarators(self, of: Node) -> list[Node]:
        out = []
        while True:
            line, own = self.line, self.name()
            kind = self.dims(copy(of))
            node = Node("variable", line, name=own, kids=[kind])
            if self.accept("="):
                node.kids.append(self.array_init(self.initializer) if self.text == "{" else self.expression())
            node.end = self.last()
            out.append(node)
            if not self.accept(","):
                return out

    def initializer(self) -> Node:
        return self.array_init(self.initializer) if self.text == "{" else self.expression()

    def array_init(self, rule) -> Node:
        line = self.line
        self.expect("{")
        kids = []
        while self.text != "}":
            kids.append(rule())
            if not self.accept(","):
                break
        self.expect("}")
        return Node("array", line, self.last(), kids=kids)

    def parameters(self, close: str) -> list[Node]:
        out = []
        while self.text != close:
            line = self.line
            notes = self.modifiers()
            of = self.type()
            self.annotations()
            more = self.accept("...")
            if self.text == "this" or (self.is_name() and self.peek() == "." and self.peek(2) == "this"):
                while self.text != "this":
                    self.i += 1
                self.i += 1
            else:
                own = self.name()
                of = self.dims(of)
                out.append(Node("parameter", line, self.last(), own, [*notes, of], of=of, more=more))
            if not self.accept(","):
                break
        self.expect(close)
        return out

    # statements

    def block(self) -> Node:
        line = self.line
        self.expect("{")
        kids = []
        while not self.accept("}"):
            if self.t[self.i][0] == "end":
                self.fail("'}'")
            kids.append(self.statement())
        return Node("block", line, self.last(), kids=kids)

    def local(self) -> Node:
        """A local variable declaration without its semicolon."""
        line = self.line
        notes = self.modifiers()
        of = self.var_type()
        if not self.is_name() or self.peek() not in ("=", ";", ",", "[", ":", ")"):
            self.fail("a declarator")
        node = Node("local", line, kids=notes + self.declarators(of))
        node.end = self.last()
        return node

    def var_type(self) -> Node:
        if self.text == "var" and self.is_name(1):
            self.i += 1
            return Node("type", self.t[self.i - 1][2], name="var", form="var")
        return self.type()

    def statement(self) -> Node:
        line, word = self.line, self.text
        if word == "{":
            return self.block()
        if self.accept(";"):
            return Node("empty", line)
        if self.is_name() and self.peek() == ":" and self.peek(2) != ":":
            self.i += 2
            return Node("labeled", line, kids=[self.statement()])
        rule = getattr(self, f"do_{word}", None) if self.t[self.i][0] == "name" else None
        if rule and not (word == "yield" and self.peek() in ("=", ".", "(", "[", "++", "--")) and not (word == "switch" and False):
            node = rule()
            node.line, node.end = line, self.last()
            return node
        at = self.i
        self.attempt(self.modifiers)
        if self.starts_type():
            notes_at = self.i
            self.i = at
            notes = self.modifiers()
            self.i = notes_at
            return Node("local_class", line, kids=[self.declared_type(line, notes)], end=self.last())
        self.i = at
        node = self.attempt(self.local)
        if node is not None and self.text == ";":
            self.i += 1
            return node
        self.i = at
        node = self.explicit_call() or self.expression()
        self.expect(";")
        return Node("statement", line, self.last(), kids=[node])

    def explicit_call(self) -> Node | None:
        at, line = self.i, self.line
        args = self.attempt(self.type_args) or [] if self.text == "<" else []
        if self.text in ("this", "super") and self.peek() == "(":
            which = self.text
            self.i += 2
            return Node("explicit", line, name=which, kids=args + self.arguments(), end=self.last())
        self.i = at
        return None

    def paren(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def do_if(self) -> Node:
        self.i += 1
        kids = [self.paren(), self.statement()]
        if self.accept("else"):
            kids.append(self.statement())
        return Node("if", 0, kids=kids)

    def do_while(self) -> Node:
        self.i += 1
        return Node("while", 0, kids=[self.paren(), self.statement()])

    def do_do(self) -> Node:
        self.i += 1
        kids = [self.statement()]
        self.expect("while")
        kids.append(self.paren())
        self.expect(";")
        return Node("do", 0, kids=kids)

    def do_for(self) -> Node:
        self.i += 1
        self.expect("(")
        kids = []
        first = self.attempt(self.local)
        if first is not None and self.accept(":"):
            kids = [first, self.expression()]
        else:
            if first is not None:
                kids.append(first)
            elif self.text != ";":
                kids.append(self.expression())
                while self.accept(","):
                    kids.append(self.expression())
            self.expect(";")
            if self.text != ";":
                kids.append(self.expression())
            self.expect(";")
            while self.text != ")":
                kids.append(self.expression())
                if not self.accept(","):
                    break
        self.expect(")")
        return Node("for", 0, kids=[*kids, self.statement()])

    def do_return(self) -> Node:
        self.i += 1
        kids = [] if self.text == ";" else [self.expression()]
        self.expect(";")
        return Node("return", 0, kids=kids)

    def do_throw(self) -> Node:
        self.i += 1
        kids = [self.expression()]
        self.expect(";")
        return Node("throw", 0, kids=kids)

    def do_yield(self) -> Node:
        return self.do_throw()

    def do_break(self) -> Node:
        self.i += 1
        if self.is_name():
            self.i += 1
        self.expect(";")
        return Node("break", 0)

    do_continue = do_break

    def do_assert(self) -> Node:
        self.i += 1
        kids = [self.expression()]
        if self.accept(":"):
            kids.append(self.expression())
        self.expect(";")
        return Node("assert", 0, kids=kids)

    def do_synchronized(self) -> Node:
        self.i += 1
        return Node("synchronized", 0, kids=[self.paren(), self.block()])

    def do_try(self) -> Node:
        self.i += 1
        kids = []
        if self.accept("("):
            while self.text != ")":
                kids.append(self.attempt(self.local) or self.expression())
                if not self.accept(";"):
                    break
            self.expect(")")
        kids.append(self.block())
        while self.accept("catch"):
            self.expect("(")
            line = self.line
            notes = self.modifiers()
            of = [self.type()]
            while self.accept("|"):
                of.append(self.type())
            kind = of[0] if len(of) == 1 else Node("type", line, self.last(), " | ".join(x.name for x in of), of, form="union")
            kids.append(Node("parameter", line, self.last(), self.name(), [*notes, kind], of=kind))
            self.expect(")")
            kids.append(self.block())
        if self.accept("finally"):
            kids.append(self.block())
        return Node("try", 0, kids=kids)

    def do_switch(self) -> Node:
        node = self.switch()
        if self.text in (".", "["):
            self.fail("a statement")
        return node

    def switch(self) -> Node:
        line = self.line
        self.i += 1
        kids = [self.paren()]
        self.expect("{")
        while not self.accept("}"):
            if self.accept("case"):
                while True:
                    if self.accept("default"):
                        pass
                    else:
                        kids.append(self.attempt(self.pattern, ("->", ":", ",", "&&")) or self.ternary())
                    if not self.accept(","):
                        break
            else:
                self.expect("default")
            if self.accept("->"):
                kids.append(self.statement() if self.text in ("{", "throw") else Node("statement", self.line, kids=[self.expression()]))
                self.accept(";")
            else:
                self.expect(":")
                while self.text not in ("case", "default", "}") or (self.text == "default" and self.peek() not in (":", "->")):
                    kids.append(self.statement())
        return Node("switch", line, self.last(), kids=kids)

    def pattern(self, stops: tuple[str, ...]) -> Node:
        line = self.line
        notes = self.modifiers()
        of = self.type()
        own = self.name()
        if stops and self.text not in stops:
            self.fail("the end of a pattern")
        return Node("pattern", line, self.last(), own, [*notes, of])

    # expressions

    def arguments(self) -> list[Node]:
        """Arguments after an opening parenthesis, and the closing one."""
        out = []
        while self.text != ")":
            out.append(self.expression())
            if not self.accept(","):
                break
        self.expect(")")
        return out

    def expression(self) -> Node:
        line = self.line
        node = self.ternary()
        at = self.i
        if self.text in ASSIGN:
            self.i += 1
        elif self.text in (">", ">=") and self._shift(assign=True):
            pass
        else:
            self.i = at
            return node
        return Node("assign", line, kids=[node, self.expression()], end=self.last())

    def _shift(self, assign: bool) -> bool:
        """``>>`` and ``>>>`` come as single signs; so do their assignments."""
        at = self.i
        n = 0
        while self.text == ">":
            self.i += 1
            n += 1
        if assign and self.text == ">=" and 1 <= n <= 2:
            self.i += 1
            return True
        if not assign and 2 <= n <= 3 and self.text != ">=":
            return True
        self.i = at
        return False

    def ternary(self) -> Node:
        line = self.line
        found = self.lambda_()
        if found is not None:
            return found
        node = self.binary()
        if self.accept("?"):
            kids = [node, self.lambda_() or self.ternary()]
            self.expect(":")
            kids.append(self.lambda_() or self.ternary())
            node = Node("conditional", line, self.last(), kids=kids)
        return node

    def binary(self) -> Node:
        line = self.line
        node = self.unary()
        while True:
            if self.accept("instanceof"):
                self.accept("final")
                kind = self.attempt(self.pattern, ()) or self.type()
                node = Node("instanceof", line, self.last(), kids=[node, kind])
            elif self.text == ">" and self.peek() == ">" and self._shift(assign=False) or self.text in BINARY and not (self.text == ">" and self.peek() in (">", ">=")) and self.accept(self.text):
                node = Node("binary", line, kids=[node, self.lambda_() or self.unary()], end=self.last())
            else:
                return node

    def unary(self) -> Node:
        line = self.line
        if self.text in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            return Node("unary", line, kids=[self.unary()], end=self.last())
        if self.text == "(":
            cast = self.attempt(self.cast)
            if cast is not None:
                return cast
        node = self.postfix(self.primary(), line)
        while self.text in ("++", "--"):
            self.i += 1
            node = Node("unary", line, kids=[node], end=self.last())
        return node

    def cast(self) -> Node:
        line = self.line
        self.expect("(")
        of = self.type()
        parts = [of]
        while self.accept("&"):
            parts.append(self.type())
        self.expect(")")
        if len(parts) > 1:
            of = Node("type", parts[0].line, self.last(), " & ".join(p.name for p in parts), parts, form="intersection")
        kind = self.t[self.i][0]
        if of.more["form"] != "primitive":
            if not (kind in ("name", "text", "number") or self.text in ("(", "!", "~")) or self.text == "instanceof":
                self.fail("an operand")
        return Node("cast", line, kids=[of, self.lambda_() or self.unary()], end=self.last(), of=of)

    def lambda_(self) -> Node | None:
        line = self.line
        if self.is_name() and self.peek() == "->":
            p = [Node("parameter", line, name=self.name(), kids=[Node("type", line, name="", form="unknown")])]
        elif self.text == "(":
            depth, k = 0, self.i
            while k < len(self.t):
                s = self.t[k][1] if self.t[k][0] == "op" else ""
                depth += (s == "(") - (s == ")")
                k += 1
                if not depth:
                    break
            if k >= len(self.t) or self.t[k][1] != "->":
                return None
            self.i += 1
            if self.is_name() and self.peek() in (",", ")"):
                p = []
                while self.text != ")":
                    p.append(Node("parameter", self.line, name=self.name(), kids=[Node("type", self.line, name="", form="unknown")]))
                    self.accept(",")
                self.expect(")")
            else:
                p = []
                while self.text != ")":
                    at = self.line
                    notes = self.modifiers()
                    of = self.var_type()
                    self.accept("...")
                    p.append(Node("parameter", at, name=self.name(), kids=[*notes, of]))
                    self.accept(",")
                self.expect(")")
        else:
            return None
        self.expect("->")
        body = self.block() if self.text == "{" else self.expression()
        return Node("lambda", line, self.last(), kids=[*p, body])

    def primary(self) -> Node:
        line, kind, word = self.line, self.t[self.i][0], self.text
        if kind in ("text", "number") or word in ("true", "false", "null"):
            self.i += 1
            return Node("literal", line, self.last())
        if word == "(":
            self.i += 1
            e = self.expression()
            self.expect(")")
            return Node("parens", line, self.last(), kids=[e])
        if word == "switch":
            return self.switch()
        if word == "new":
            return self.creation(line, [])
        if word in ("this", "super"):
            self.i += 1
            if word == "super" and self.text == "::":
                return Node(word, line)
            return Node(word, line)
        if word in PRIMITIVES or word == "void":
            of = self.result()
            if self.accept("::"):
                self.accept("new") or self.name()
                return Node("reference", line, self.last(), kids=[of])
            self.expect(".")
            self.expect("class")
            return Node("class_literal", line, self.last(), kids=[of])
        if self.is_name() or word == "@":
            literal = self.attempt(self.typed)
            if literal is not None:
                return literal
        own = self.name()
        if self.accept("("):
            return Node("call", line, name=own, kids=self.arguments(), end=self.last())
        return Node("name", line, name=own)

    def typed(self) -> Node:
        """``Type::method`` and ``Type.class``."""
        line = self.line
        k = self.i
        while k < len(self.t) and (self.t[k][0] == "name" or self.t[k][1] in (".", "<", ">", ",", "[", "]", "?", "@", "&")):
            k += 1
        at = self.i
        if self.t[k][1] == "::":
            of = self.type()
            if self.accept("::"):
                self.accept("new") or self.name()
                return Node("reference", line, self.last(), kids=[of])
            self.i = at
        names = self.i
        while self.is_name(0) and self.peek() == "." and self.peek(2) != "class":
            self.i += 2
        if not (self.is_name() and (self.peek() in (".", "["))):
            self.fail()
        end = self.i + 1
        self.i = names
        of = None
        while self.i < end:
            own = self.name()
            of = Node("type", line, name=f"{of.name}.{own}" if of else own, kids=[of] if of else [], form="class")
            if self.i < end:
                self.expect(".")
        of = self.dims(of)
        self.expect(".")
        self.expect("class")
        return Node("class_literal", line, self.last(), kids=[of])

    def creation(self, line: int, scope: list[Node]) -> Node:
        self.expect("new")
        self.annotations()
        args = self.type_args() if self.text == "<" else []
        of = self.type(dims=False)
        if self.text in ("[", "@"):
            kids = [of]
            while self.text in ("[", "@"):
                self.annotations()
                self.expect("[")
                if self.text != "]":
                    kids.append(self.expression())
                self.expect("]")
            if self.text == "{":
                kids.append(self.array_init(self.initializer))
            return Node("array_creation", line, self.last(), kids=scope + kids)
        self.expect("(")
        node = Node("creation", line, kids=scope + args + [of, *self.arguments()], of=of)
        if self.text == "{":
            self.body(node, "")
        node.end = self.last()
        return node

    def postfix(self, node: Node, line: int) -> Node:
        while True:
            if self.accept("["):
                node = Node("index", line, kids=[node, self.expression()])
                self.expect("]")
            elif self.accept("::"):
                self.accept("new") or self.name()
                node = Node("reference", line, self.last(), kids=[node])
            elif self.text == ".":
                self.i += 1
                if self.text == "new":
                    node = self.creation(line, [node])
                    continue
                args = self.type_args() if self.text == "<" else []
                if self.text in ("this", "super") and not args:
                    word = self.text
                    self.i += 1
                    if word == "super" and self.text == "(":
                        self.i += 1
                        node = Node("explicit", line, name="super", kids=[node, *self.arguments()], end=self.last())
                    else:
                        # the scope of a qualified this or super is a name, not an expression
                        node = Node(word, line, self.last())
                    continue
                own = self.name()
                if self.accept("("):
                    node = Node("call", line, name=own, kids=[node, *args, *self.arguments()], end=self.last())
                else:
                    node = Node("access", line, self.last(), own, [node])
            else:
                return node


def copy(node: Node) -> Node:
    return Node(node.kind, node.line, node.end, node.name, [copy(k) for k in node.kids], **node.more)


def parse(source: str) -> Node:
    try:
        return Parser(source).unit()
    except RecursionError:
        raise Failure(0, "nested too deeply") from None


TYPES = ("class", "interface")


def is_field(n: Node) -> bool:
    return n.kind == "variable" and n.above("field") is not None


def qualified_name(n: Node, package: str) -> str | None:
    """Types before, members after what is found on the way up."""
    names: list[str] = []
    while n is not None:
        if n.kind in TYPES:
            names.insert(0, n.name)
        elif n.kind in ("method", "constructor") or is_field(n):
            names.append(n.name)
        n = n.up
    if not names:
        return None
    return ".".join(([package] if package.strip() else []) + names)


def signature(n: Node) -> str:
    return ",".join(re.sub("<.*>", "<>", re.sub(r"\s+", "", p.more["of"].name)) for p in n.more["params"])


def entity_key(n: Node, package: str) -> tuple[str, str, str, str, int]:
    """(type, declaring type, name, parameters, start line); the file completes it."""
    qn = qualified_name(n, package)
    if n.kind in TYPES:
        return n.kind.upper(), "", qn or n.name, "", n.line
    owner = n.above(*TYPES)
    declaring = (qualified_name(owner, package) or "") if owner else ""
    kind = "FIELD" if n.kind == "variable" else n.kind.upper()
    return kind, declaring, qn or n.name, signature(n) if n.kind != "variable" else "", n.line


def source_key(n: Node | None, package: str) -> tuple | None:
    """The key of the nearest declaration around a node, itself included."""
    while n is not None:
        if n.kind in ("method", "constructor", *TYPES) or is_field(n):
            return entity_key(n, package)
        if n.kind == "field":
            return entity_key(next(k for k in n.kids if k.kind == "variable"), package)
        n = n.up
    return None


def facts(unit: Node) -> tuple[list[dict], list[dict]]:
    """Entities and relations of a unit, in the order of the source."""
    package, entities, relations = unit.name, [], []
    nodes = list(unit.walk())

    def entity(n: Node) -> None:
        kind, declaring, name, params, line = entity_key(n, package)
        entities.append({"entity_type": kind, "declaring": declaring, "key_name": name, "params": params, "start_line": line, "end_line": n.end, "simple_name": n.name, "qualified_name": qualified_name(n, package)})

    def relation(n: Node, kind: str, text: str, **more) -> None:
        key = source_key(n, package)
        relations.append({"relation_type": kind, "target_text": text, "source_line": n.line, "source_key": key, "target_key": None, "target_name": None} | more)

    for n in nodes:
        if n.kind in TYPES and n.above("local_class") is None:
            entity(n)
    for kind in ("method", "constructor"):
        for n in nodes:
            if n.kind == kind:
                entity(n)
    for n in nodes:
        if n.kind == "variable" and n.up is not None and n.up.kind == "field":
            entity(n)
    heads: set[int] = set()
    for n in nodes:
        if n.kind in TYPES:
            for t in n.more["extends"]:
                relation(t, "EXTENDS", t.name)
            for t in n.more["implements"]:
                relation(t, "IMPLEMENTS", t.name)
            heads |= {id(t) for t in n.more["extends"] + n.more["implements"]}
    for n in nodes:
        if n.kind == "type" and n.more["form"] != "void" and id(n) not in heads:
            relation(n, "TYPE_REFERENCE", n.name)
    for n in nodes:
        if n.kind == "creation":
            relation(n, "CONSTRUCTOR_CALL", n.more["of"].name)
    for n in nodes:
        if n.kind == "call":
            relation(n, "METHOD_CALL", n.name)
    for n in nodes:
        if n.kind == "explicit":
            relation(n, "CONSTRUCTOR_CALL", n.name)
    fields: dict[str, dict] = {}
    for e in entities:
        if e["entity_type"] == "FIELD":
            fields.setdefault(e["simple_name"], e)

    def field(n: Node) -> None:
        e = fields.get(n.name)
        bound = {} if e is None else {"target_name": e["qualified_name"] or e["simple_name"], "target_key": tuple(e[k] for k in ("entity_type", "declaring", "key_name", "params", "start_line"))}
        relation(n, "FIELD_REFERENCE", n.name, **bound)

    for n in nodes:
        if n.kind == "access":
            field(n)
    for n in nodes:
        if n.kind == "name" and n.name in fields:
            variable, parameter = n.above("variable"), n.above("parameter", "pattern")
            named_alike = (variable is not None and variable.name == n.name) or (parameter is not None and parameter.kind == "parameter" and parameter.name == n.name)
            if not named_alike and not (n.up.kind == "call" and n.up.name == n.name) and n.above("type") is None:
                field(n)
    return entities, relations
