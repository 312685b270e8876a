"""Licence scans: Aho-Corasick for tags and notices, shunting-yard for expressions.

Each text is reduced to its words, and one automaton finds all notice phrases
and the identifier tag in a single pass over it. Where the tag stands, the
expression after it is read from the text itself; a shunting-yard parser turns
``and``, ``or``, ``with`` and brackets into postfix order, which is evaluated
to the identifiers named and to whether some choice among them is permissive.
A comma before another identifier is an ``and``; words that follow an identifier
with no operator end the expression, or are its title's where a bracket is open.

Defined results: words are runs of 0-9, a-z (A-Z lower-cased) and all bytes
from 0x80; a null or empty text has no words, no places and score 0; rows with
a null id and repeated rows are scanned like others; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import ALNUM, sliced, task, utf8

#: Phrases whose places are counted, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices, with the identifiers they stand for.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3.0",
    "gnu affero general public license version 3": "agpl-3.0",
    "mozilla public license version 2": "mpl-2.0",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "creative commons attribution 4 0": "cc-by-4.0",
    "creative commons attribution sharealike 4 0": "cc-by-sa-4.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "the unlicense": "unlicense",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "zlib license": "zlib",
    "boost software license version 1 0": "bsl-1.0",
    "eclipse public license version 2 0": "epl-2.0",
    "eclipse public license v 2 0": "epl-2.0",
    "european union public licence v 1 2": "eupl-1.2",
    "eupl v1 2": "eupl-1.2",
    "gplv2": "gpl-2.0",
    "gplv3": "gpl-3.0",
    "lgplv3": "lgpl-3.0",
    "agplv3": "agpl-3.0",
    "apache org licenses license 2 0": "apache-2.0",
    "creativecommons org publicdomain zero 1 0": "cc0-1.0",
    "cc0 1 0": "cc0-1.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nc nd 4 0": "cc-by-nc-nd-4.0",
}
TAG = "spdx license identifier"
#: Identifiers whose terms let a text be used with no more than a notice.
PERMISSIVE = {"mit", "apache-2", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "zlib", "bsl-1.0", "cc0-1.0", "cc-by-4.0"}

_SIGNS = rb"[\x00-/:-@\[-`{-\x7f]+"
#: With other signs than hyphens the three words may be running text, unless a colon or equals sign follows.
_TAGGED = re.compile(rb"spdx(?:-license-identifier\s*:?|" + _SIGNS + rb"license" + _SIGNS + rb"identifier\s*[:=])\s*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[(),]|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: What may follow a comma as one more identifier: a name with a version, or one of those above.
_IDENTIFIER = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*-\d[a-z0-9.+-]*|\d[a-z]+")
_KNOWN = PERMISSIVE | {*BASE.values(), *NOTICES.values()}
_BINDS = {"or": 1, "and": 2, "with": 3}


class BadExpression(ValueError):
    pass


def postfix(expression: str) -> list[str]:
    """Tokens of a licence expression in postfix order; identifiers in lower case."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    found = [t.lower() for t in _TOKEN.findall(expression)]
    for token, after in zip(found, [*found[1:], ")"]):
        if token == ",":
            if not operand or after in _BINDS or after in "),":
                continue
            if not _IDENTIFIER.fullmatch(after) and after not in _KNOWN:
                break  # running text follows
            token = "and"
        if token in _BINDS:
            if not operand:
                raise BadExpression(expression)
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        elif token == "(":
            if operand:
                raise BadExpression(expression)
            held.append(token)
        elif token == ")":
            if not operand:
                raise BadExpression(expression)
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise BadExpression(expression)
            held.pop()
        elif operand and "(" in held:
            continue  # more words of a title in brackets
        elif operand:
            # trailing words after a whole expression, as in a comment
            break
        else:
            out.append(token)
            operand = True
    if not operand or "(" in held:
        raise BadExpression(expression)
    return out + held[::-1]


@dataclass(frozen=True)
class Term:
    names: frozenset[str]
    permissive: bool


def evaluated(expression: str) -> Term:
    """The identifiers of an expression and whether one may choose permissive terms."""
    stack: list[Term] = []
    for token in postfix(expression):
        if token not in _BINDS:
            stack.append(Term(frozenset([token]), token in PERMISSIVE))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # an exception only adds permissions
            stack.append(Term(frozenset(f"{a} with {b}" for a in left.names for b in right.names), left.permissive))
        elif token == "and":
            stack.append(Term(left.names | right.names, left.permissive and right.permissive))
        else:
            stack.append(Term(left.names | right.names, left.permissive or right.permissive))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    found.make_automaton()
    return found


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if ALNUM[b] else 32 for b in range(256))


@dataclass
class Scan:
    n_words: int = 0
    places: list[int] = field(default_factory=list)
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    tags: int = 0
    bad: int = 0
    permissive: bool | None = None

    @property
    def score(self) -> float:
        if self.base or self.tags > self.bad:
            return 1.0
        return 0.8 if self.labels else 0.3 if self.bad else 0.0


def scan(text: bytes, automaton: ahocorasick.Automaton) -> Scan:
    """Everything found in one text, given as UTF-8."""
    words = text.translate(_FOLD).split()
    out = Scan(n_words=len(words))
    plain = b" " + b" ".join(words) + b" "
    at = word = 0
    notices: set[str] = set()
    # a byte is one character here, so that places in the two agree
    for end, (kind, label, size) in automaton.iter(plain.decode("latin-1")):
        if kind == "base":
            start = end - size
            if start >= at:
                word += plain.count(b" ", at, start)
                place = word
            else:
                place = word - plain.count(b" ", start, at)
            at, word = start, place
            out.places.append(place)
            out.base.add(label)
        elif kind == "notice":
            notices.add(label)
        else:
            out.tags = -1
    if out.tags:
        out.tags = 0
        for m in _TAGGED.finditer(text):
            out.tags += 1
            try:
                term = evaluated(m[1].decode("utf-8", "replace"))
            except BadExpression:
                out.bad += 1
                continue
            out.labels |= term.names
            out.permissive = term.permissive if out.permissive is None else out.permissive and term.permissive
    # notices and base phrases hold beside the expressions, whatever these allow
    notices |= out.base
    out.labels |= notices
    if notices:
        out.permissive = notices <= PERMISSIVE and out.permissive is not False
    return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_tags long, permissive boolean"
)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and places of base phrases, labels, score and expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in (part for batch in batches for part in sliced(batch, "t")):
            data, bounds = utf8(batch.column("t"))
            raw = data.tobytes()
            rows = []
            for doc, a, b in zip(batch.column("i").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                s = scan(raw[a:b], found)
                first, last = (min(s.places), max(s.places)) if s.places else (None, None)
                rows.append((doc, s.n_words, len(s.places), first, last, ",".join(sorted(s.base)), ",".join(sorted(s.labels)), s.score, s.tags, s.permissive))
            if rows:
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.bool_()]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(task(run), SCHEMA)
