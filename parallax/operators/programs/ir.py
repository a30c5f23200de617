"""Python programs as an indexed syntax tree.

A program is one plain top-level function. Its tree is numbered in pre-order (trace nodes), and
each statement, like the function header, is a semantic step that owns the nodes below it up to
the next statement.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from typing import Any

Path = tuple[str | int, ...]

#: Syntax that a program must not hold, and statements that it may. Fixed values.
FORBIDDEN = ("AsyncFunctionDef", "ClassDef", "Import", "ImportFrom", "Lambda", "Try", "With", "AsyncWith", "AsyncFor", "Yield", "YieldFrom", "Global", "Nonlocal", "ListComp", "SetComp", "DictComp", "GeneratorExp")
STATEMENTS = ("Assign", "AnnAssign", "AugAssign", "For", "While", "If", "Return", "Expr", "Break", "Continue", "Pass")
POSITIONS = ("lineno", "col_offset", "end_lineno", "end_col_offset")


class ProgramError(ValueError):
    """A program that this engine does not represent."""


def kind(node: ast.AST) -> str:
    return type(node).__name__


def children(node: ast.AST) -> Iterator[tuple[ast.AST, Path]]:
    """Direct sub-nodes with their step of path, in field order."""
    for name in node._fields:
        value = getattr(node, name, None)
        for suffix, item in [((), value)] if not isinstance(value, list) else [((i,), v) for i, v in enumerate(value)]:
            if isinstance(item, ast.AST):
                yield item, (name, *suffix)


def walk(root: ast.AST) -> Iterator[tuple[ast.AST, Path]]:
    """All nodes with their paths, in pre-order, without recursion."""
    stack: list[tuple[ast.AST, Path]] = [(root, ())]
    while stack:
        node, path = stack.pop()
        yield node, path
        stack += reversed([(child, path + step) for child, step in children(node)])


def key_of(path: Path) -> str:
    return "/".join(map(str, path))


def at(root: ast.AST, path_key: str) -> ast.AST:
    """The node under a path key."""
    found: Any = root
    for part in path_key.split("/") if path_key else []:
        found = found[int(part)] if isinstance(found, list) else getattr(found, part)
    return found


def problems(tree: ast.Module) -> list[str]:
    """Why a module is not a program; empty if it is one."""
    if len(tree.body) != 1 or kind(tree.body[0]) != "FunctionDef":
        return ["expected one top-level function"]
    function = tree.body[0]
    args = function.args
    found = []
    if function.decorator_list:
        found.append("decorators are not supported")
    if args.vararg or args.kwarg or args.kwonlyargs:
        found.append("only positional parameters are supported")
    if args.defaults or any(args.kw_defaults):
        found.append("default values are not supported")
    for node, _ in walk(function):
        if kind(node) in FORBIDDEN:
            found.append(f"forbidden syntax: {kind(node)}")
        elif isinstance(node, ast.stmt) and node is not function and kind(node) not in STATEMENTS:
            found.append(f"unsupported statement: {kind(node)}")
    return found


def function_of(source: str) -> ast.FunctionDef:
    """The function of a program text; ProgramError if the text is not a program."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as error:
        raise ProgramError(f"not parseable: {error}") from None
    if found := problems(tree):
        raise ProgramError("; ".join(dict.fromkeys(found)))
    return tree.body[0]


def index(function: ast.FunctionDef) -> tuple[list[dict], list[dict]]:
    """Trace nodes and semantic steps."""
    nodes, steps = [], []
    owner: dict[Path, str] = {}
    for number, (node, path) in enumerate(walk(function), 1):
        trace = f"N{number:04d}"
        if isinstance(node, ast.stmt):
            step = f"S{len(steps) + 1:03d}"
            steps.append({"semantic_step_id": step, "kind": "FUNCTION_INTERFACE" if node is function else kind(node).upper(), "path_key": key_of(path), "trace_node_id": trace})
        else:
            up = path[:-2] if isinstance(path[-1], int) else path[:-1]
            step = owner[up]
        owner[path] = step
        nodes.append({"trace_node_id": trace, "node_type": kind(node), "path_key": key_of(path), "owner_semantic_step_id": step})
    return nodes, steps


def dump(node: Any) -> Any:
    """A tree as plain data, with positions."""
    if isinstance(node, list):
        return [dump(x) for x in node]
    if not isinstance(node, ast.AST):
        return node if node is None or isinstance(node, (str, int, float, bool)) else {"_repr": repr(node)}
    return {"_type": kind(node)} | {f: dump(getattr(node, f, None)) for f in node._fields} | {p: getattr(node, p) for p in POSITIONS if hasattr(node, p)}


def load(value: Any) -> Any:
    """The tree of dump()'s data."""
    if isinstance(value, list):
        return [load(x) for x in value]
    if not isinstance(value, dict):
        return value
    if "_repr" in value:
        return ast.literal_eval(value["_repr"])
    made = getattr(ast, value["_type"])(**{f: load(v) for f, v in value.items() if f != "_type" and f not in POSITIONS})
    for p in POSITIONS:
        if value.get(p) is not None:
            setattr(made, p, value[p])
    return made


def program(task_id: str, family: str, task_text: str, variant: int, source: str, natural: str | None) -> dict:
    """One row of the programs table."""
    function = function_of(source)
    nodes, steps = index(function)
    return {
        "program_id": f"{task_id}__v{variant}", "task_id": task_id, "family": family, "variant": variant, "task_text": task_text, "source_python": source, "source_nl": natural, "function_name": function.name,
        "parameters": [a.arg for a in function.args.args], "statement_count": len(steps) - 1, "ast": json.dumps(dump(function), ensure_ascii=False), "trace_nodes": nodes, "semantic_steps": steps,
    }


#: Syntax that an audit sample has to show. Fixed values.
CONSTRUCTS = {"while": "While", "break": "Break", "boolean_expression": "BoolOp", "dict": "Dict", "attribute_or_method": "Attribute"}
LOOPS = ("For", "While", "If")


def constructs(function: ast.FunctionDef) -> set[str]:
    """Names of the constructs that a program shows."""
    seen = {kind(node) for node, _ in walk(function)}
    found = {"function_interface"} | {name for name, node in CONSTRUCTS.items() if node in seen}
    for node, _ in walk(function):
        if kind(node) in LOOPS and any(kind(inner) in LOOPS for inner, path in walk(node) if path):
            found.add("nested_control_flow")
            break
    return found


def audit_sample(by_task: dict[str, set[str]], required: set[str], size: int, seed: int) -> list[str]:
    """A seeded sample of tasks, extended greedily until it shows every required construct.

    The task that adds most comes next, of equals the last by name. Takes as many rows as there
    are tasks; works on the driver.
    """
    import random

    tasks = sorted(by_task)
    chosen = sorted(random.Random(seed).sample(tasks, min(size, len(tasks))))
    while missing := required - set().union(*(by_task[t] for t in chosen)):
        gain, best = max(((len(by_task[t] & missing), t) for t in tasks if t not in chosen), default=(0, ""))
        if not gain:
            raise ProgramError(f"no task shows {sorted(missing)}")
        chosen.append(best)
    return chosen
