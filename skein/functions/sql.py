"""The functions of this package for SQL: register() makes them temporary functions of a session.

A function's Column is written out as SQL text, which becomes the body of a SQL function. So it is expanded into the
query's plan like any other expression: nothing runs in Python, and filters on it are pushed down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import content_type, text, urls

#: SQL name -> (function, number of arguments, type of its result)
FUNCTIONS: dict[str, tuple[Callable[..., Column], int, str]] = {k: (f, n, "BOOLEAN" if ".is_" in f"{f.__module__}.{f.__name__}" else "STRING") for k, (f, n) in urls.SQL_FUNCTIONS.items()} | {
    "md_escape": (text.escape_markdown, 1, "STRING"), "yaml_escape": (text.yaml_escape, 1, "STRING"), "strip_tags": (text.strip_tags, 1, "STRING"), "word_count": (text.word_count, 1, "BIGINT"),
    "collapse_space": (text.collapse, 1, "STRING"), "duration_ms": (text.duration_ms, 1, "BIGINT"), "sniff_content_type": (content_type.sniff, 1, "STRING"), "code_language": (text.code_language, 1, "STRING"),
}
_INFIX = {"=": "=", "==": "=", "<=>": "<=>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "and": "AND", "or": "OR"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def text_of(node) -> str:
    """The SQL text of a node of a Column's tree."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name, args = node.functionName(), [text_of(a) for a in _items(node.arguments())]
        if name.lower() in _INFIX and len(args) == 2:
            return f"({args[0]} {_INFIX[name.lower()]} {args[1]})"
        return f"(NOT {args[0]})" if name in ("!", "not") else f"{name}({', '.join(args)})"
    if kind == "LambdaFunction":
        names = [v.sql() for v in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {text_of(node.function())}"
    if kind == "CaseWhenOtherwise":
        branches = " ".join(f"WHEN {text_of(b._1())} THEN {text_of(b._2())}" for b in _items(node.branches()))
        other = node.otherwise()
        return f"(CASE {branches}{' ELSE ' + text_of(other.get()) if other.isDefined() else ''} END)"
    if kind == "Cast":
        return f"CAST({text_of(node.child())} AS {node.dataType().sql()})"
    if kind == "Alias":
        return f"{text_of(node.child())} AS {', '.join(_items(node.name()))}"
    if kind == "UnresolvedExtractValue":
        field = node.extraction()
        return f"{text_of(node.child())}.{field.value()}" if field.getClass().getSimpleName() == "Literal" and isinstance(field.value(), str) else f"{text_of(node.child())}[{text_of(field)}]"
    return node.sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Makes the functions temporary functions of the session, under their names behind prefix, and gives the names."""
    for name, (f, n, kind) in FUNCTIONS.items():
        arguments = [f"a{i}" for i in range(n)]
        body = text_of(f(*[F.col(a) for a in arguments])._jc.node())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(a + ' STRING' for a in arguments)}) RETURNS {kind} RETURN {body}")
    return [prefix + k for k in FUNCTIONS]
