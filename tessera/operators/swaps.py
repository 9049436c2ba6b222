"""Field swaps: a CASE or IF over a parameter whose branches are bare fields picks the field before the plan is made."""

from __future__ import annotations

from tessera.plans.ast import Binary, Cond, Field, Lit, Node, Param
from tessera.plans.errors import Unsupported
from tessera.plans.model import SemanticModel
from tessera.plans.parser import parse


def swap_branches(tree: Node) -> tuple[str, dict[object, str], str | None] | None:
    """(parameter, field by value, field otherwise) of a swap; None for any other tree. NULL and label branches are left out."""
    if not isinstance(tree, Cond):
        return None
    parameter, fields = None, {}
    for test, value in tree.arms:
        if not (isinstance(test, Binary) and test.op == "=" and isinstance(test.left, Param) and isinstance(test.right, Lit)):
            return None
        if parameter not in (None, test.left.name):
            return None
        parameter = test.left.name
        if isinstance(value, Field):
            fields[test.right.value] = value.name
        elif not isinstance(value, Lit):
            return None
    other = tree.other.name if isinstance(tree.other, Field) else None
    return (parameter, fields, other) if parameter and fields else None


def swap_field(model: SemanticModel, formula: str, given: dict | None = None) -> str:
    """The caption that the parameter's value chooses, so the other branches are never read."""
    found = swap_branches(parse(formula))
    if found is None:
        raise Unsupported("type_or_shape_mismatch", "not a field swap")
    name, fields, other = found
    value = (given or {}).get(name, model.parameters[name].value)
    chosen = fields.get(value, other)
    if chosen is None:
        raise Unsupported("model_object_parameter", f"{name} = {value!r} chooses no field")
    return chosen
