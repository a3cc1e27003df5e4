"""Product projections of integrated source (JOIN-1, PRJ-1 to PRJ-4)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill import shared

from .directives import ids_of, recognise

_BREAK = re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_VARIANT = re.compile(r"^([ \t\n\x0B\f\r]*)//@([^\n\r\u0085\u2028\u2029]*)$")
_ANNOTATION = re.compile(r"[A-Z][A-Za-z0-9_]*([ \t\n\x0B\f\r]*\([^\n\r\u0085\u2028\u2029]*)?")


def restore(line: str) -> str:
    """An active line without its variant marker; a lone annotation gets its ``@`` back (PRJ-2)."""
    m = _VARIANT.match(line)
    if not m:
        return line
    return m[1] + ("@" if _ANNOTATION.fullmatch(m[2]) else "") + m[2]


def project(source: str, product: str) -> tuple[str, int]:
    """The source as one product has it, with as many lines, and that number (PRJ-1, PRJ-3, PRJ-4)."""
    lines = _BREAK.split(source)
    if source.endswith(("\n", "\r")):
        lines.pop()
    out: list[str] = []
    stack: list[list[bool]] = []  # whether the parent is active, a branch was taken, this branch is active
    for line in lines:
        found = recognise(line)
        if found is None:
            out.append(restore(line) if not stack or stack[-1][2] else "")
            continue
        out.append("")
        word, expression = found
        match = product in ids_of(expression)
        if word == "if":
            parent = not stack or stack[-1][2]
            stack.append([parent, match, parent and match])
        elif stack and word == "endif":
            stack.pop()
        elif stack:
            top = stack[-1]
            hit = match or word == "else"
            top[2] = top[0] and not top[1] and hit
            top[1] = top[1] or hit
    return "\n".join(out), len(lines)


def variants(source: str, products: list[str]) -> dict[str, list[str]]:
    """The distinct projections of a source and the products of each: what is parsed once."""
    out: dict[str, list[str]] = {}
    for p in products:
        out.setdefault(project(source, p)[0], []).append(p)
    return out


def generate(files: DataFrame, universe: DataFrame) -> DataFrame:
    """file, product, src, line_count for each file and product; ``universe`` is one row (JOIN-1)."""
    shared.ship(files.sparkSession)
    pairs = shared.dealt(files.where("src is not null"), "path").crossJoin(universe.select(F.explode("universe").alias("product")))

    def run(parts):
        for part in parts:
            made = [project(s, p) for s, p in zip(part["src"], part["product"], strict=True)]
            yield pd.DataFrame({"file": part["path"], "product": part["product"], "src": [m[0] for m in made], "line_count": [m[1] for m in made]})

    return pairs.select("path", "src", "product").mapInPandas(run, "file string, product string, src string, line_count int")
