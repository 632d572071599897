"""Names that lines of Python code load and bind. Parsing has no relational form, so these are UDFs;
lines that don't parse are read by their identifiers."""

import ast
import builtins
import keyword
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
BUILTINS = sorted(dir(builtins))
_IMPORT = re.compile(r"\s*(?:from\s+[\w.]+\s+)?import\s+(.+)")
_DEF = re.compile(rf"(?:async\s+)?def\s+({NAME})\s*(?:\(([^)]*)\))?")
_CLASS = re.compile(rf"class\s+({NAME})\b")
_ASSIGNED = re.compile(rf"({NAME})\s*=")


def _tree(code: str) -> ast.AST | None:
    try:
        return ast.parse(code)
    except (SyntaxError, ValueError):
        return None


def used(code: str) -> set[str]:
    tree = _tree(code)
    if tree is None:
        found = set(re.findall(NAME, code))
    else:
        found = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}
    return found - set(keyword.kwlist)


def parameters(code: str) -> set[str]:
    head = _DEF.match(code)
    if not head or head[2] is None:
        return set()
    plain = (re.split("[:=]", p.strip().lstrip("*"))[0].strip() for p in head[2].split(","))
    return {p for p in plain if re.fullmatch(NAME, p)}


def bound(code: str) -> set[str]:
    """Imports with their aliases, what stands before an equals sign, functions, classes, parameters."""
    found = set(_ASSIGNED.findall(code)) | parameters(code)
    if got := _IMPORT.match(code):
        for part in got[1].split(","):
            found |= {side.split(".")[0] for side in part.strip().split(" as ", 1)}
    for kind in (_DEF, _CLASS):
        if got := kind.match(code):
            found.add(got[1])
    if tree := _tree(code):
        for n in ast.walk(tree):
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                found.add(n.name)
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                found.add(n.id)
    return found


def _over(function):
    @F.pandas_udf(ArrayType(StringType()))
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: sorted(function(c)) if c is not None else [])

    return run


used_names, bound_names, parameter_names = _over(used), _over(bound), _over(parameters)
