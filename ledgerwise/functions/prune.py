"""Partial evaluation of a formula at one value of a version key."""

from __future__ import annotations

import operator

from .syntax import Compare, FormulaError, If, Node, Number, Reference, bare, parse

_TESTS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_TURNED = {">": "<", ">=": "<=", "<": ">", "<=": ">=", "==": "==", "!=": "!="}


def threshold(node: Node, variable: str) -> tuple[str, int] | None:
    """(operator, number) of `variable op number`, either way round."""
    node = bare(node)
    if not isinstance(node, Compare):
        return None
    a, b, op = bare(node.left), bare(node.right), node.op
    if isinstance(a, Number):
        a, b, op = b, a, _TURNED[op]
    if isinstance(a, Reference) and isinstance(b, Number) and a.parts[-1].lower() == variable.lower():
        return op, int(b.value)
    return None


def prune(text: str, variable: str, value: int) -> str:
    """text with each IF whose every condition tests the variable replaced by the branch taken; the rest stays as written."""
    try:
        tree = parse(text)
    except FormulaError:
        return text

    def chosen(node: If) -> tuple[bool, Node | None]:
        tests = [threshold(c, variable) for c, _ in node.branches]
        if None in tests:
            return False, None
        for (op, number), (_, branch) in zip(tests, node.branches):
            if _TESTS[op](value, number):
                return True, branch
        return True, node.otherwise

    def edits(node: Node) -> list[tuple[int, int, str]]:
        if isinstance(node, If):
            pruned, branch = chosen(node)
            if pruned:
                return [(*node.span, "NULL" if branch is None else rewritten(branch))]
        return [e for c in node.children() for e in edits(c)]

    def rewritten(node: Node) -> str:
        a, b = node.span
        out, at = [], a
        for x, y, new in sorted(edits(node)):
            out += [text[at:x], new]
            at = y
        return "".join([*out, text[at:b]])

    if not edits(tree):
        return text
    return rewritten(tree).strip()
