"""Checks of a formula alone, and against the source it came from."""

from __future__ import annotations

import re

from .repair import repair
from .syntax import FUNCTIONS, Arithmetic, Call, Compare, FormulaError, If, Logic, Node, Number, Reference, bare, parse, references


def grammar(text: str | None) -> list[str]:
    """Empty, incomplete, unparsable, unknown functions, text in + or -."""
    if not text or not text.strip():
        return ["Empty expression"]
    try:
        tree = parse(repair(text))
    except FormulaError as e:
        return [str(e)]
    out = []
    for n in tree.walk():
        if isinstance(n, Call) and n.name not in FUNCTIONS:
            out.append(f"Unknown function: {n.name}")
        if isinstance(n, Arithmetic) and n.op in "+-" and any(isinstance(bare(x), Reference) and bare(x).maybe_text for x in (n.left, n.right)):
            out.append(f"Text in {n.op}: {text[n.span[0] : n.span[1]]}")
    return out


def self_reference(tree: Node, entity: str, column: str, preserved: bool = False) -> list[str]:
    """The formula reads what it derives, though its source doesn't keep it."""
    own = {f"{entity}.{column}".upper(), column.upper()}
    return [f"Reads its own target {r}" for r in references(tree) if not preserved and r.upper() in own]


def invented(tree: Node, source: str) -> list[str]:
    """Names and numbers that the source doesn't hold; 0 and 1 are free."""
    words = {w.upper() for w in re.findall(r"\w+", source)}
    numbers = {x.lstrip("0") or "0" for x in re.findall(r"\d+(?:\.\d+)?", source)}
    free = {"VAR", "BUSINESS_DATE"}
    out = [f"Unknown name {p}" for r in references(tree) for p in r.split(".") if p.upper() not in words | free]
    out += [f"Unknown number {n.value}" for n in tree.walk() if isinstance(n, Number) and abs(n.value) not in (0, 1) and str(abs(n.value)).lstrip("0") not in numbers]
    return list(dict.fromkeys(out))


def _constant(n: Node) -> bool:
    n = bare(n)
    return isinstance(n, Number) or isinstance(n, Reference) and n.maybe_text


def constant_conditions(tree: Node) -> list[str]:
    return ["Compares constants only" for n in tree.walk() if isinstance(n, Compare) and _constant(n.left) and _constant(n.right)]


def same_branches(tree: Node) -> list[str]:
    return ["THEN and ELSE are equal" for n in tree.walk() if isinstance(n, If) and len(n.branches) == 1 and n.otherwise is not None and bare(n.branches[0][1]) == bare(n.otherwise)]


def repeated_conditions(tree: Node, decided: tuple[Node, ...] = ()) -> list[str]:
    """A condition inside a branch that its own outer condition has decided."""
    tree, out = bare(tree), []
    if isinstance(tree, If):
        before: tuple[Node, ...] = ()
        for c, v in tree.branches:
            c = bare(c)
            if c in decided:
                out.append("Repeats a condition that is decided")
            before += (c,)
            out += repeated_conditions(v, decided + before)
        return out + (repeated_conditions(tree.otherwise, decided + before) if tree.otherwise else [])
    return [x for n in tree.children() for x in repeated_conditions(n, decided)]


def mixed_logic(tree: Node) -> list[str]:
    """An AND without parentheses under an OR."""
    return ["AND inside OR needs parentheses" for n in tree.walk() if isinstance(n, Logic) and n.op == "OR" and not n.call and any(isinstance(x, Logic) and x.op == "AND" and not x.call for x in n.args)]


def without_comments(sql: str) -> str:
    """SQL without -- and /* */ comments; quoted text stays."""
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\")|--[^\n]*|/\*.*?(?:\*/|\Z)", lambda m: m[1] or " ", sql, flags=re.S)


def dropped(tree: Node, source: str) -> list[str]:
    """Guards and aggregates of the source that the formula shows no trace of."""
    clean, used = without_comments(source), {p.upper() for r in references(tree) for p in r.split(".")}
    out = []
    for m in re.finditer(r"\bWHERE\b(.*?)(?:;|\bWHEN\b|\bGROUP\b|\bORDER\b|\Z)", clean, re.I | re.S):
        names = {w.upper() for w in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", m[1]))}
        if names and not names & used:
            out.append("Drops a WHERE guard")
    entities = {r.split(".")[0].upper() for r in references(tree) if "." in r}
    if re.search(r"\b(?:MIN|MAX|SUM|COUNT|AVG|LISTAGG)\s*\(", clean, re.I) and re.search(r"\bGROUP\s+BY\b", clean, re.I) and len(entities) < 2:
        out.append("Drops an aggregation")
    return list(dict.fromkeys(out))


def check(text: str, entity: str = "", column: str = "", source: str | None = None, preserved: bool = False) -> list[str]:
    """All findings on a formula; those against a source only if one is given. preserved: the source keeps the column's own value."""
    found = grammar(text)
    if found:
        return found
    tree = parse(repair(text))
    found = constant_conditions(tree) + same_branches(tree) + repeated_conditions(tree) + mixed_logic(tree)
    if column:
        found += self_reference(tree, entity, column, preserved)
    if source is not None:
        found += invented(tree, source) + dropped(tree, source)
    return found


