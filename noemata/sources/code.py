"""Facts from source code: what a module imports, defines, calls, inherits, returns, raises, decorates and mutates.

Python is read with the standard library's ast. JavaScript and TypeScript are read by a small scanner of tokens, with braces
matched, which needs no parser. Extractors are functions (path, source bytes) -> rows, kept by file ending in a registry, and
run over a table of files by mapInArrow.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import grounding

Row = tuple[str, str, str, int, str]  # subject, predicate, object, line, node
Extractor = Callable[[str, bytes], Iterator[Row]]
SCHEMA = "path string, subject string, predicate string, object string, line_number int, node_type string"


def python_rows(path: str, source: bytes) -> Iterator[Row]:
    """Rows of a Python file, in the order of the text. Files that don't parse give none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    module = PurePosixPath(path).stem

    def name(node: ast.AST) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def value(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return node.id
        return str(node.value) if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, bool)) else "value"

    stack: list[tuple[ast.AST, str]] = [(tree, module)]
    while stack:
        node, owner = stack.pop()
        line, within = getattr(node, "lineno", 0), owner
        match node:
            case ast.Import(names=[first, *_]) if first.asname is None:
                yield module, "imports", first.name, line, "import_statement"
            case ast.ImportFrom(module=str(origin)):
                yield module, "imports", origin, line, "import_from_statement"
            case ast.Call(func=func) if name(func):
                yield owner, "calls", name(func), line, "call"
            case ast.ClassDef():
                yield module, "defines", node.name, line, "class_definition"
                for base in node.bases:
                    if isinstance(base, ast.Name):
                        yield node.name, "inherits", base.id, line, "class_definition"
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                yield module, "defines", node.name, line, "function_definition"
                for mark in node.decorator_list:
                    if isinstance(mark, ast.Name):
                        yield mark.id, "decorates", node.name, node.decorator_list[0].lineno, "decorated_definition"
                within = node.name
            case ast.Return() if owner != module:
                yield owner, "returns", value(node.value) if node.value else "value", line, "return_statement"
            case ast.Raise(exc=exc) if exc is not None:
                raised = exc.func if isinstance(exc, ast.Call) else exc
                if isinstance(raised, ast.Name):
                    yield owner, "raises", raised.id, line, "raise_statement"
            case ast.Assign() | ast.AugAssign() | ast.AnnAssign():
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                        yield owner, "mutates", target.attr, line, "assignment"
        outer = set(map(id, getattr(node, "decorator_list", ())))
        stack += [(child, owner if id(child) in outer else within) for child in reversed(list(ast.iter_child_nodes(node)))]


_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?\*/|(?P<text>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|[{}()\[\];,.=<>!+\-*/%&|?:^~]=*)",
    re.S,
)
_NOT_CALLED = frozenset({"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "constructor"})


def javascript_rows(path: str, source: bytes) -> Iterator[Row]:
    """Rows of a JavaScript or TypeScript file."""
    text, module = source.decode("utf-8", "replace"), PurePosixPath(path).stem
    found = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(text) if m.lastgroup]
    lines = [0] + [m.end() for m in re.finditer("\n", text)]

    def line(at: int) -> int:
        import bisect

        return bisect.bisect_right(lines, at)

    def origin(quoted: str) -> str:
        inner = quoted[1:-1]
        return PurePosixPath(inner).stem if inner.startswith((".", "/")) else inner

    value = lambda i: found[i][1] if 0 <= i < len(found) else ""
    kind = lambda i: found[i][0] if 0 <= i < len(found) else ""

    def closing(i: int) -> int:
        depth = 0
        for k in range(i, len(found)):
            depth += {"(": 1, ")": -1}.get(found[k][1], 0)
            if not depth:
                return k
        return len(found)

    owners: list[tuple[str, int, bool]] = []  # name, depth of the body, whether a class
    depth, opening = 0, None
    for i, (what, x, at) in enumerate(found):
        owner = next((o[0] for o in reversed(owners) if not o[2]), module)
        if x == "{":
            depth += 1
            if opening:
                owners.append((opening[0], depth, opening[1]))
                opening = None
        elif x == "}":
            while owners and owners[-1][1] == depth:
                owners.pop()
            depth -= 1
        if what != "name":
            continue
        before, after = value(i - 1), value(i + 1)
        if x == "import" and before != ".":
            quoted = next((value(k) for k in range(i + 1, min(len(found), i + 200)) if kind(k) == "text" or value(k) == ";"), "")
            if quoted[:1] in "'\"" and quoted:
                yield module, "imports", origin(quoted), line(at), "import_statement"
        elif x == "class" and kind(i + 1) == "name":
            yield module, "defines", after, line(at), "class_declaration"
            if value(i + 2) == "extends" and kind(i + 3) == "name" and value(i + 4) != ".":
                yield after, "inherits", value(i + 3), line(at), "class_declaration"
            opening = (after, True)
        elif x == "function" and kind(i + 1) == "name":
            yield module, "defines", after, line(at), "function_declaration"
            opening = (after, False)
        elif x == "return" and owner != module:
            plain = kind(i + 1) == "name" and value(i + 2) in (";", "}", "")
            yield owner, "returns", after if plain else "value", line(at), "return_statement"
        elif x == "throw":
            raised = i + 2 if after == "new" else i + 1
            if kind(raised) == "name" and value(raised + 1) != ".":
                yield owner, "raises", value(raised), line(at), "throw_statement"
        elif x == "this" and after == "." and value(i + 3) == "=":
            yield owner, "mutates", value(i + 2), line(at), "assignment_expression"
        if after == "(" and x not in _NOT_CALLED or x == "constructor" and after == "(":
            method = owners and owners[-1][2] and owners[-1][1] == depth and value(closing(i + 1) + 1) in ("{", ":")
            if method:
                opening = (x, False)
            elif x != "constructor" and before not in ("new", "function"):
                yield owner, "calls", x, line(at), "call_expression"


class Registry:
    """Extractors by file ending."""

    def __init__(self):
        self.by_ending: dict[str, Extractor] = {}
        self.register(".py", python_rows)
        for ending in (".js", ".jsx", ".ts", ".tsx"):
            self.register(ending, javascript_rows)

    @staticmethod
    def _ending(ending: str) -> str:
        return "." + ending.lower().lstrip(".")

    def register(self, ending: str, extractor: Extractor) -> None:
        self.by_ending[self._ending(ending)] = extractor

    def has(self, ending: str) -> bool:
        return self._ending(ending) in self.by_ending

    def extensions(self) -> list[str]:
        return sorted(self.by_ending)


def code_facts(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Rows of SCHEMA from files (path, content); files without an extractor give none."""
    by_ending = dict((registry or Registry()).by_ending)

    def extracted(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                extractor = by_ending.get(PurePosixPath(path).suffix.lower())
                rows += [(path, *r) for r in extractor(path, content or b"")] if extractor else []
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string()] * 4 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "subject", "predicate", "object", "line_number", "node_type"])

    return files.select("path", "content").mapInArrow(extracted, SCHEMA)


def as_observations(rows: DataFrame, at: F.Column) -> DataFrame:
    """Code rows as observed facts, with the confidence and importance that code has."""
    importance = F.struct(*[F.lit(v).alias(n) for n, v in (("activation", 0.8), ("coherence", 0.7), ("specificity", 0.8), ("novelty", 0.5), ("reinforcement", 0.5))])
    ground = grounding("ast", file_path=F.col("path"), line_number=F.col("line_number"), node_type=F.col("node_type"))
    return rows.select("subject", "predicate", "object", F.lit(True).alias("polarity"), F.lit(0.9).alias("confidence"), importance.alias("importance"), ground.alias("grounding"), at.alias("timestamp"), F.struct("path", "line_number", "predicate", "object").alias("seq"))
