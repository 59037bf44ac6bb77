"""Entities of one Python file: by the syntax tree if the file compiles, otherwise by lines and indentation."""

from __future__ import annotations

import ast
import re


def _text(source: str, node: ast.AST | None) -> str | None:
    return ast.get_source_segment(source, node) if node is not None else None


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Call):
        node = node.func
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        inner = _dotted(node.value)
        return f"{inner}.{node.attr}" if inner else node.attr
    return None


def _root_name(node: ast.AST) -> str | None:
    while True:
        if isinstance(node, ast.Name):
            return node.id
        node = getattr(node, "value", None) or getattr(node, "func", None)
        if node is None:
            return None


def access_of(name: str) -> str | None:
    """Two leading underscores mean private, one (and a dunder) protected; other names have none."""
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else None


def _calls(node: ast.AST) -> tuple[list[str], list[dict]]:
    plain, methods, seen = [], [], set()
    arguments, objects = set(), set()
    for n in ast.walk(node):
        if isinstance(n, ast.Call):
            for a in [*n.args, *[k.value for k in n.keywords]]:
                arguments |= {id(x) for x in ast.walk(a)}
        elif isinstance(n, ast.Attribute):
            objects |= {id(x) for x in _spine(n.value)}
    for n in sorted((n for n in ast.walk(node) if isinstance(n, ast.Call)), key=lambda n: (n.end_lineno, n.end_col_offset)):
        flags = {"is_nested": id(n) in arguments, "is_chained": id(n) in objects, "line": n.lineno}
        if isinstance(n.func, ast.Name):
            if n.func.id not in seen:
                seen.add(n.func.id)
                plain.append({"name": n.func.id, "call_type": "constructor" if n.func.id[0].isupper() else "function", "receiver": None, **flags})
        elif isinstance(n.func, ast.Attribute):
            receiver = _root_name(n.func.value)
            methods.append({"name": n.func.attr, "call_type": "static" if receiver and receiver[0].isupper() else "method", "receiver": receiver, **flags})
    details = plain + methods
    return list(dict.fromkeys(c["name"] for c in details)), details


def _spine(node: ast.AST):
    while node is not None:
        yield node
        node = node.func if isinstance(node, ast.Call) else getattr(node, "value", None)


def _function_names(node: ast.AST) -> list[str]:
    """All functions below a node, in the order of the text."""
    found = [n for n in ast.walk(node) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return [n.name for n in sorted(found, key=lambda n: (n.lineno, n.col_offset))]


def _docstring(source: str, body: list[ast.stmt]) -> str | None:
    for statement in body:
        if isinstance(statement, ast.Expr) and isinstance(statement.value, ast.Constant) and isinstance(statement.value.value, str):
            return (_text(source, statement.value) or "").strip("'\"").strip()
    return None


def _parameters(code: str) -> str:
    start = code.find("(")
    depth = 0
    for i in range(max(start, 0), len(code)):
        depth += {"(": 1, ")": -1}.get(code[i], 0)
        if depth == 0 and code[i] == ")":
            return code[start: i + 1]
    return "()"


def python_entities(source: str, compat: bool = False) -> tuple[list[dict], list[dict], list[dict], list[str]]:
    """Functions, classes, types (none) and imports."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_lines(source)
    functions, classes, imports = [], [], []

    def visit(node: ast.AST, path: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = path
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                code = _text(source, child) or ""
                calls, details = _calls(ast.Module(body=child.body, type_ignores=[]))
                decorators = [d for d in map(_dotted, child.decorator_list) if d]
                functions.append({
                    "name": child.name, "start_line": child.lineno, "end_line": child.end_lineno, "code": code, "signature": child.name + _parameters(code),
                    "docstring": _docstring(source, child.body), "class_name": ".".join(path) or None, "decorators": decorators, "calls": calls, "call_details": details,
                    "is_async": isinstance(child, ast.AsyncFunctionDef), "is_constructor": child.name == "__init__", "access_modifier": access_of(child.name),
                    "is_static": "staticmethod" in decorators, "is_abstract": bool({"abstractmethod", "abc.abstractmethod"} & {*decorators}), "return_type": _text(source, child.returns)})
            elif isinstance(child, ast.ClassDef):
                decorators = [d for d in map(_dotted, child.decorator_list) if d]
                bases = [b for b in (_dotted(b) if isinstance(b, (ast.Name, ast.Attribute)) else None for b in child.bases) if b]
                classes.append({
                    "name": child.name, "start_line": child.lineno, "end_line": child.end_lineno, "code": _text(source, child) or "", "docstring": _docstring(source, child.body),
                    "bases": bases, "decorators": decorators, "methods": _function_names(child),
                    "access_modifier": access_of(child.name), "is_abstract": bool({"ABC", "abc.ABC"} & {*bases}), "is_interface": False})
                inner = (*path, child.name)
            elif isinstance(child, ast.Import):
                imports.extend(a.name for a in child.names if not (compat and a.asname))
            elif isinstance(child, ast.ImportFrom) and not (compat and child.level):
                imports.append("." * child.level + (child.module or ""))
            visit(child, inner)

    visit(tree, ())
    return functions, classes, [], sorted({i for i in imports if i})


_HEAD = re.compile(r"^([ \t]*)(async\s+)?(def|class)\s+(\w+)")
_CALL = re.compile(r"(?:([A-Za-z_]\w*)\.(?:\w+\.)*)?([A-Za-z_]\w*)\s*\(")
_KEYWORDS = frozenset("if for while return and or not in is elif def class with print lambda assert yield except del raise import from".split())


def _by_lines(source: str) -> tuple[list[dict], list[dict], list[dict], list[str]]:
    """What a file that doesn't compile still shows."""
    lines = source.expandtabs(8).split("\n")
    functions, classes, imports, open_ = [], [], [], []
    for i, line in enumerate(lines):
        if m := re.match(r"\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))", line):
            imports.append(m.group(1) or m.group(2))
        if not (m := _HEAD.match(line)):
            continue
        indent = len(m.group(1))
        end = i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > indent):
            end += 1
        while end > i + 1 and not lines[end - 1].strip():
            end -= 1
        open_ = [o for o in open_ if o[0] < indent]
        code, name = "\n".join([line.lstrip(), *lines[i + 1: end]]), m.group(4)
        base = {"name": name, "start_line": i + 1, "end_line": end, "code": code, "decorators": [], "access_modifier": access_of(name), "is_abstract": False}
        if m.group(3) == "class":
            inside = re.search(r"\(([^()]*)\)", line)
            classes.append(base | {"docstring": None, "bases": [b.strip() for b in inside.group(1).split(",") if b.strip() and "=" not in b] if inside else [], "is_interface": False,
                                   "methods": re.findall(r"^\s*(?:async\s+)?def\s+(\w+)", code, re.M)})
            open_.append((indent, name))
        else:
            found = [(r, n) for r, n in _CALL.findall(code.partition("\n")[2]) if n not in _KEYWORDS]
            details = [{"name": n, "call_type": "method" if r else "function", "receiver": r or None, "is_nested": False, "is_chained": False, "line": None} for r, n in found]
            functions.append(base | {
                "signature": name + _parameters(code), "docstring": None, "class_name": ".".join(o[1] for o in open_) or None, "call_details": details,
                "calls": list(dict.fromkeys([n for r, n in found if not r] + [n for r, n in found if r])), "is_async": bool(m.group(2)), "is_constructor": name == "__init__",
                "is_static": False, "return_type": None})
    return functions, classes, [], sorted(set(imports))
