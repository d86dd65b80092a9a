"""Capsules of Python files, by the standard library's syntax tree; one task handles a batch of files."""

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.extract_common import capsule, rows_to_frame
from lodeseek.schema import CAPSULE

#: Base classes that make a class an exception.
EXCEPTIONS = {"Exception", "BaseException", "ValueError", "TypeError", "KeyError", "RuntimeError", "OSError", "IOError", "HTTPException"}


def _stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name


class _File:
    def __init__(self, path: str, text: str):
        self.path, self.text, self.module = path, text, _stem(path)

    def source(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.text, node) or ast.unparse(node)

    def row(self, node: ast.AST, kind: str, name: str, signature: str, ident: str | None = None, **more) -> dict:
        last = getattr(node, "end_lineno", None) or node.lineno
        return capsule(self.path, kind, name, node.lineno, last, "python", signature, ident=ident, **({"content": self.source(node)} | more))


def _called(node: ast.AST) -> list[str]:
    return [c.func.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)]


def _size(node: ast.AST) -> int:
    return (node.end_lineno or node.lineno) - node.lineno + 1


def _imports(f: _File, node: ast.stmt) -> list[dict]:
    if isinstance(node, ast.Import):
        return [f.row(node, "module", a.name, f"import {a.name}", imports=[a.name]) for a in node.names]
    out = []
    for a in node.names:
        full = f"{node.module}.{a.name}" if node.module else a.name
        out.append(f.row(node, "class" if a.name[:1].isupper() else "function", full, f"from {node.module or ''} import {a.name}", imports=[node.module or ""]))
    return out


def _function(f: _File, node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    args, gap = node.args.args, len(node.args.args) - len(node.args.defaults)
    params = []
    for i, a in enumerate(args):
        text = a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "")
        params.append(text + (f" = {ast.unparse(node.args.defaults[i - gap])}" if i >= gap else ""))
    returns = ast.unparse(node.returns) if node.returns else "None"
    is_async = isinstance(node, ast.AsyncFunctionDef)
    marks = [ast.unparse(d) for d in node.decorator_list]
    doc = ast.get_docstring(node)
    if not doc and _size(node) <= 15:
        doc = f.source(node)[:300]
    fixture = any("pytest.fixture" in m or m.split("(")[0].strip("@") == "fixture" for m in marks)
    kind = "test" if node.name.startswith("test_") else "async_function" if is_async else "test" if fixture else "function"
    joined = ", ".join(params)
    props = [("parametros", joined), ("tipo_retorno", returns), ("lineas", _size(node)), ("module", f.module)] + ([("decorators", ", ".join(marks))] if marks else [])
    return [f.row(node, kind, node.name, f"{'async def' if is_async else 'def'} {node.name}({joined}) -> {returns}", docstring=doc, calls=_called(node), properties=props)]


def _class(f: _File, node: ast.ClassDef) -> list[dict]:
    bases = [ast.unparse(b) for b in node.bases]
    marks = [ast.unparse(d) for d in node.decorator_list]
    methods = [m.name for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
    if any(m.split("(")[0].strip("@") == "dataclass" for m in marks):
        kind = "dataclass"
    elif any(b.split("(")[0].split("[")[0].split(".")[-1] in EXCEPTIONS for b in bases):
        kind = "exception"
    else:
        kind = "class"
    joined = ", ".join(bases)
    props = [("metodos", ", ".join(methods)), ("hereda_de", joined), ("lineas", _size(node)), ("module", f.module)] + ([("decorators", ", ".join(marks))] if marks else [])
    return [f.row(node, kind, node.name, f"class {node.name}({joined})" if bases else f"class {node.name}", docstring=ast.get_docstring(node), calls=_called(node), properties=props)]


def _assignment(f: _File, node: ast.Assign | ast.AnnAssign) -> list[dict]:
    out = []
    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
        if isinstance(t, ast.Name):
            kind, raw = "constant" if t.id.isupper() else "variable", f.source(node)
            out.append(f.row(node, kind, t.id, raw if len(raw) <= 120 else f"{t.id} = ...", ident=f"{kind} {t.id}", content=raw, properties=[("module", f.module)]))
    return out


def _entry(f: _File, node: ast.If) -> list[dict]:
    test = ast.unparse(node.test)
    if "__name__" not in test or "__main__" not in test:
        return []
    return [f.row(node, "entrypoint", f"{f.module}.__main__", "if __name__ == '__main__'", ident="entrypoint", content=f.source(node)[:2000], properties=[("lineas", _size(node)), ("module", f.module)])]


HANDLERS = {
    ast.Import: _imports, ast.ImportFrom: _imports, ast.FunctionDef: _function, ast.AsyncFunctionDef: _function, ast.ClassDef: _class,
    ast.Assign: _assignment, ast.AnnAssign: _assignment, ast.If: _entry,
}


def header(f: _File, tree: ast.Module) -> list[dict]:
    """What stands before the first definition: module docstring, imports, upper-case constants."""
    defs = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    first = min([min([n.lineno, *[d.lineno for d in n.decorator_list]]) for n in defs], default=None)
    lines = f.text.split("\n")
    head = "\n".join(lines[: first - 1] if first else lines).strip()
    before = [n for n in tree.body if first is None or n.lineno < first]
    imports = [a.name for n in before if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in before if isinstance(n, ast.ImportFrom)]
    constants = [t.id for n in before if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name) and t.id.isupper()]
    doc = ast.get_docstring(tree)
    if not (doc or imports or constants):
        return []
    end = (first - 1) if first else len(lines)
    return [capsule(f.path, "file_header", f"{f.module}.__header__", 1, max(1, end), "python", f"header {f.module}", content=head, docstring=doc, imports=imports, properties=[("constants", ", ".join(constants)), ("module", f.module)])]


def extract(path: str, text: str) -> list[dict]:
    """Top-level capsules of one file; a file that does not parse gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    f = _File(path, text)
    out = header(f, tree)
    for node in tree.body:
        handler = HANDLERS.get(type(node))
        out += handler(f, node) if handler else []
    return out


def python_capsules(files: DataFrame) -> DataFrame:
    """files (file_path, content) -> capsules; an unexpected failure gives one row with type 'error'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield rows_to_frame(b["file_path"], b["content"], lambda p, t, _: extract(p, t))

    return files.select("file_path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(run, CAPSULE)
