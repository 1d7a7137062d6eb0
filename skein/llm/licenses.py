"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

The scan is local to rows and reads whole texts: one pass per text with the
automaton. An expression after an identifier tag runs to the end of its line or comment.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = "spdx-license-identifier:"
#: Notice phrase (lower case, single spaces) -> licence identifier.
PHRASES = {
    "licensed under the apache license, version 2.0": "Apache-2.0",
    "apache license, version 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "released under the mit license": "MIT",
    "under the mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "redistribution and use in source and binary forms": "BSD-3-Clause",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license, v. 2.0": "MPL-2.0",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu affero general public license, version 3": "AGPL-3.0-only",
    "licensed under cc by 4.0": "CC-BY-4.0",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "licensed under cc by-nd 4.0": "CC-BY-ND-4.0",
    "dedicated to the public domain": "CC0-1.0",
    "all rights reserved": "LicenseRef-Proprietary",
}
#: Identifiers whose texts may be used.
ALLOWED = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "Zlib", "MPL-2.0")
#: Exceptions that make a licence usable that isn't by itself: (identifier, exception).
EXCEPTIONS = (("GPL-2.0-only", "Classpath-exception-2.0"), ("GPL-2.0-or-later", "Classpath-exception-2.0"), ("GPL-3.0-only", "GCC-exception-3.1"), ("GPL-3.0-or-later", "GCC-exception-3.1"))
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.:-]*\+?)")
#: Where the expression after a tag ends: at its line or at the first end of its comment.
_COMMENT_END = re.compile(r"[\r\n]|\*/|-->|//|#")
_BIND = {"with": 3, "and": 2, "or": 1}


def to_postfix(expression: str) -> list[str]:
    """The tokens of a licence expression in postfix order. ValueError if it is malformed.

    "with" binds closer than "and", and "and" closer than "or". Words are lower case.
    """
    out: list[str] = []
    ops: list[str] = []
    operand, at, text = False, 0, expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:at + 10]!r}")
        at, t = m.end(), m.group(1).lower()
        if t == "(":
            if operand:
                raise ValueError("an operator is missing")
            ops.append(t)
        elif t == ")":
            if not operand:
                raise ValueError("an operand is missing")
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ValueError("unbalanced )")
            ops.pop()
        elif t in _BIND:
            if not operand:
                raise ValueError("an operand is missing")
            while ops and ops[-1] != "(" and _BIND[ops[-1]] >= _BIND[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = False
        else:
            if operand:
                raise ValueError("an operator is missing")
            out.append(t)
            operand = True
    if not operand:
        raise ValueError("an operand is missing")
    while ops:
        if ops[-1] == "(":
            raise ValueError("unbalanced (")
        out.append(ops.pop())
    return out


def allows(postfix: list[str], allowed: frozenset[str], exceptions: frozenset[tuple[str, str]]) -> bool:
    """The value of a postfix expression, an identifier being true if allowed. x+ stands for x-or-later.

    "x with e" is true if x is allowed or (x, e) is among the exceptions. ValueError if "with" has an expression as operand.
    """
    names = {a.lower() for a in allowed}
    pairs = {(a.lower(), b.lower()) for a, b in exceptions}
    full = lambda x: x[:-1] + "-or-later" if x.endswith("+") else x
    ok = lambda x: x in names or full(x) in names or x.rstrip("+") in names
    stack: list[str | bool] = []
    for t in postfix:
        if t not in _BIND:
            stack.append(t)
            continue
        b, a = stack.pop(), stack.pop()
        if t == "with":
            if isinstance(a, bool) or isinstance(b, bool):
                raise ValueError("with takes two names")
            stack.append(ok(a) or (full(a), b) in pairs)
            continue
        a, b = (x if isinstance(x, bool) else ok(x) for x in (a, b))
        stack.append(a and b if t == "and" else a or b)
    last = stack.pop()
    return last if isinstance(last, bool) else ok(last)


@lru_cache(8)
def _automaton(phrases: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p, name in phrases:
        a.add_word(p, (len(p), name))
    a.add_word(TAG, (len(TAG), None))
    a.make_automaton()
    return a


def _phrases_in(flat: str, phrases: tuple[tuple[str, str], ...]) -> tuple[list[str], bool]:
    """The licences of the phrases in a text, in the order of occurrence, and whether it has a tag. A phrase within a longer one that also stands there doesn't count, nor does one within a longer word."""
    found, tagged = [], False
    for end, (n, name) in _automaton(phrases).iter(flat):
        if name is None:
            tagged = True
        elif not (end >= n and flat[end - n].isalnum()) and not flat[end + 1 : end + 2].isalnum():
            found.append((end - n + 1, -end, name))
    names, reached = [], -1
    for _, end, name in sorted(found):
        if -end > reached:
            names.append(name)
            reached = -end
    return names, tagged


def scan(text: str | None, phrases: tuple[tuple[str, str], ...], allowed: frozenset[str], exceptions: frozenset[tuple[str, str]]) -> tuple[list[str], str]:
    """The distinct notices of a text in the order of first occurrence, and the verdict: none, allowed, denied or invalid."""
    low = (text or "").lower()
    names, tagged = _phrases_in(" ".join(low.split()), phrases)
    found = dict.fromkeys(names)
    expressions = []
    if tagged:  # an expression ends with its line or comment, which the flat text doesn't know
        for part in re.split(re.escape(TAG), low)[1:]:
            expressions.append(_COMMENT_END.split(part, maxsplit=1)[0].strip())
    verdict = "none"
    for x in [*found, *expressions]:
        try:
            now = "allowed" if allows(to_postfix(x), allowed, exceptions) else "denied"
        except ValueError:
            now = "invalid"
        verdict = max(verdict, now, key=["none", "allowed", "denied", "invalid"].index)
    return [*found, *dict.fromkeys(x for x in expressions if x not in found)], verdict


def licenses(docs: DataFrame, phrases: dict[str, str] | None = None, allowed: tuple[str, ...] = ALLOWED, exceptions: tuple[tuple[str, str], ...] = EXCEPTIONS) -> DataFrame:
    """(doc_id, n_notices, notices, verdict) for each row of docs.

    notices are distinct: identifiers of phrases as in the table, then tagged
    expressions in lower case, joined by "; ". The verdict is none without a
    notice, else the worst of its notices: invalid (an expression that can't be
    parsed), denied, allowed. Case, and line ends and runs of white space within
    a phrase, make no difference; white space is what Unicode calls so. A phrase within a longer word is none,
    and one within a longer phrase counts only with it. A text of any length is scanned whole. A null or
    empty text has no notice; an empty table gives an empty result. Rows with null or repeated doc_id have rows of
    their own; other columns aren't read.
    """
    table = tuple((phrases or PHRASES).items())
    good, pairs = frozenset(allowed), frozenset(exceptions)

    def run(batches):
        for b in batches:
            got = [scan(t.as_py(), table, good, pairs) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(n) for n, _ in got], pa.int64()), pa.array(["; ".join(n) for n, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())],
                ["doc_id", "n_notices", "notices", "verdict"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_notices long, notices string, verdict string")
