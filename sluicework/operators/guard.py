"""Static gates for record functions: safety, written fields, calls. A lint, not a sandbox."""

from __future__ import annotations

import ast

# Modules and names that no record function may touch.
BANNED_MODULES = frozenset({
    "asyncio", "builtins", "ctypes", "ftplib", "http", "importlib", "multiprocessing", "os", "pathlib", "pickle", "requests",
    "shutil", "signal", "smtplib", "socket", "subprocess", "sys", "tempfile", "threading", "urllib",
})
BANNED_NAMES = frozenset({
    "__import__", "breakpoint", "compile", "delattr", "eval", "exec", "exit", "getattr", "globals", "input", "locals", "open", "quit",
    "setattr", "vars",
})


def violations(code: str) -> list[str]:
    """What a function's code may not do; empty if it passes."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"syntax error: {e.msg}"]
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [f"import of {a.name}" for a in node.names if a.name.split(".")[0] in BANNED_MODULES]
        elif isinstance(node, ast.ImportFrom) and (node.level or (node.module or "").split(".")[0] in BANNED_MODULES):
            found.append(f"import from {node.module}")
        elif isinstance(node, ast.Name) and node.id in BANNED_NAMES:
            found.append(f"use of {node.id}")
        elif isinstance(node, ast.Attribute) and node.attr.startswith("__") and node.attr.endswith("__"):
            found.append(f"use of {node.attr}")
    return found


def written_fields(code: str, records: tuple[str, ...] = ("record", "data")) -> set[str]:
    """Fields that the code sets: by item assignment, augmented or not, update() with names, pop and setdefault."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return set()

    def of(node: ast.AST) -> set[str]:
        on = isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in records
        return {node.slice.value} if on and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str) else set()

    found: set[str] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Assign, ast.Delete)):
            found = found.union(*map(of, node.targets))
        elif isinstance(node, (ast.AugAssign, ast.AnnAssign)):
            found |= of(node.target)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name) and node.func.value.id in records:
            if node.func.attr == "update":
                found |= {k.arg for k in node.keywords if k.arg}
            elif node.func.attr in ("pop", "setdefault") and node.args and isinstance(node.args[0], ast.Constant):
                found.add(node.args[0].value)
    return found


def calls(code: str, known: set[str]) -> set[str]:
    """Which of the known functions the code calls by name."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return set()
    return {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)} & known


def split_imports(code: str) -> tuple[list[str], str]:
    """(top-level import statements, the rest of the code)."""
    tree = ast.parse(code)
    imports = [ast.unparse(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))]
    tree.body = [n for n in tree.body if not isinstance(n, (ast.Import, ast.ImportFrom))]
    return imports, ast.unparse(tree)


def merged_imports(statements: list[str]) -> list[str]:
    """Imports without repeats, names of one module on one line; __future__ first, then sorted."""
    plain, named = set(), {}
    for s in statements:
        for node in ast.parse(s).body:
            names = {(a.name, a.asname) for a in node.names}
            if isinstance(node, ast.Import):
                plain |= names
            else:
                named.setdefault(node.module, set()).update(names)
    text = lambda n: n[0] if n[1] is None else f"{n[0]} as {n[1]}"
    made = [f"import {text(n)}" for n in plain] + [f"from {m} import {', '.join(sorted(map(text, n)))}" for m, n in named.items()]
    return sorted(made, key=lambda s: (not s.startswith("from __future__"), s.startswith("from "), s))
