"""Primitives of Python functions from their syntax trees: complexity, nesting depth, distinct call targets."""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import tokenize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


class _Counts:
    def __init__(self) -> None:
        self.complexity, self.depth, self.calls = 1, 0, set()

    def deeper(self, depth: int) -> int:
        self.depth = max(self.depth, depth + 1)
        return depth + 1

    def walk(self, node: ast.AST, depth: int) -> None:
        for child in ast.iter_child_nodes(node):
            self.visit(child, depth)

    def visit(self, node: ast.AST, depth: int) -> None:
        if isinstance(node, _SCOPES):
            return
        if isinstance(node, _COMPREHENSIONS):
            # generators stand inside each other, and the element inside them all; filters stay at their level
            for g in node.generators:
                self.visit(g.iter, depth)
                self.complexity += 1 + len(g.ifs)
                depth = self.deeper(depth)
                for part in (g.target, *g.ifs):
                    self.visit(part, depth)
            for part in (node.key, node.value) if isinstance(node, ast.DictComp) else (node.elt,):
                self.visit(part, depth)
            return
        if isinstance(node, (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler)):
            self.complexity += 1
        elif isinstance(node, ast.BoolOp):
            self.complexity += len(node.values) - 1
        elif isinstance(node, ast.Match):
            self.complexity += max(0, len(node.cases) - 1)
        elif isinstance(node, ast.Call):
            self.calls.add(ast.dump(node.func))
        inner = self.deeper(depth) if isinstance(node, _NESTING) else depth
        for child in ast.iter_child_nodes(node):
            # an elif stands where its if does
            chained = isinstance(node, ast.If) and node.orelse == [child] and isinstance(child, ast.If) and child.col_offset == node.col_offset
            self.visit(child, depth if chained else inner)


def primitives(code: str | None) -> dict:
    """ast_sha256, complexity, depth, calls of the first function; nulls and a reason if there is none."""
    none = {"ast_sha256": None, "complexity": None, "depth": None, "calls": None}
    if not code:
        return none | {"reason": "missing_code"}
    try:
        body = ast.parse(code).body
        found = next((x for x in body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
        if found is None:
            return none | {"reason": "ast_ineligible"}
        counts = _Counts()
        for statement in found.body:
            counts.walk(ast.Module([statement], []), 0)
        return {"ast_sha256": hashlib.sha256(ast.dump(found).encode()).hexdigest(), "complexity": float(counts.complexity), "depth": float(counts.depth), "calls": float(len(counts.calls)), "reason": None}
    except RecursionError:
        return none | {"reason": "recursion"}
    except (SyntaxError, ValueError):
        return none | {"reason": "ast_ineligible"}


def _frame(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([primitives(c) for c in code], columns=["ast_sha256", "complexity", "depth", "calls", "reason"])


def code_primitives(code: Column) -> Column:
    return F.pandas_udf(_frame, "struct<ast_sha256:string,complexity:double,depth:double,calls:double,reason:string>")(code)


def code_tokens(code: str | None) -> list[str]:
    """Keywords and operators as they are; names, numbers and strings by kind. Text that can't be read as Python gives words, numbers and signs."""
    out: list[str] = []
    kinds = {tokenize.NUMBER: "NUMBER", tokenize.STRING: "STRING"}
    try:
        for t in tokenize.generate_tokens(io.StringIO(code or "").readline):
            if t.type == tokenize.NAME:
                out.append(t.string if keyword.iskeyword(t.string) else "NAME")
            elif t.type == tokenize.OP:
                out.append(t.string)
            elif t.type in kinds:
                out.append(kinds[t.type])
    except (IndentationError, tokenize.TokenError):
        return re.findall(r"[A-Za-z_]+|\d+|[^\w\s]", code or "")
    return out


def normal_tokens(code: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([code_tokens(c) for c in s], dtype=object), "array<string>")(code)
