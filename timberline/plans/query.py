"""The query language: parsing to a small tree, and the tree as a filter.

    query  := clause { "and" clause }         loosest
    clause := [ orlist ] { "not" phrase }
    orlist := phrase { "or" phrase }          tightest

Operator words match in any case, terms by exact case.  One delimiter on either side of an operator
word belongs to it, any further one to the phrase.  After "not" the rest up to the next "and" or
"not" is one phrase, an "or" in it included.  A query of a single token is a literal.  A clause that
starts with "not" takes its complement.  An operand that is missing is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TOKEN, WORD

OPERATORS = {"and", "or", "not"}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Phrase:
    text: str

    def column(self, line: Column) -> Column:
        pieces = self.pieces()
        if pieces is None:
            return line.contains(self.text)
        found = [line.contains(p) for p in pieces]
        if len(pieces) > 1:  # the plain conditions prune row groups, the pattern decides
            found.append(line.rlike("[^ \t:=,]*".join(re.escape(p) for p in pieces)))
        return reduce(Column.__and__, found, F.lit(True) & line.isNotNull())

    def pieces(self) -> list[str] | None:
        """The literal parts of a one-word wildcard; None for a plain phrase."""
        if "*" in self.text and re.fullmatch(WORD, self.text):
            return [p for p in self.text.split("*") if p]
        return None

    def needles(self) -> list[str]:
        got = self.pieces()
        return [self.text] if got is None else got


@dataclass(frozen=True)
class Regex:
    pattern: str

    def column(self, line: Column) -> Column:
        return line.rlike(self.pattern)


@dataclass(frozen=True)
class Token:
    """A word of the line, whole."""

    word: str

    def column(self, line: Column) -> Column:
        if not re.fullmatch(WORD, self.word):
            raise QueryError("a token has no delimiter in it")
        return line.contains(self.word) & line.rlike(f"(^|[ \t:=,]){re.escape(self.word)}([ \t:=,]|$)")


@dataclass(frozen=True)
class Common:
    """Lines that have ``least`` characters in a row in common with a text."""

    text: str
    least: int

    def column(self, line: Column) -> Column:
        parts = dict.fromkeys(self.text[i : i + self.least] for i in range(len(self.text) - self.least + 1))
        return reduce(Column.__or__, [line.contains(p) for p in parts], F.lit(False))


@dataclass(frozen=True)
class Not:
    child: object

    def column(self, line: Column) -> Column:
        return ~self.child.column(line)


@dataclass(frozen=True)
class And:
    children: tuple

    def column(self, line: Column) -> Column:
        return reduce(Column.__and__, [c.column(line) for c in self.children])


@dataclass(frozen=True)
class Or:
    children: tuple

    def column(self, line: Column) -> Column:
        return reduce(Column.__or__, [c.column(line) for c in self.children])


def lex(text: str) -> list[str]:
    return re.findall(TOKEN, text)


def _split(parts: list[str], word: str) -> list[list[str]]:
    """Cut at the operator word; one delimiter on either side goes with it."""
    out: list[list[str]] = [[]]
    i = 0
    while i < len(parts):
        if parts[i].lower() == word:
            if out[-1] and not re.fullmatch(WORD, out[-1][-1]):
                out[-1].pop()
            out.append([])
            if i + 1 < len(parts) and not re.fullmatch(WORD, parts[i + 1]):
                i += 1
        else:
            out[-1].append(parts[i])
        i += 1
    return out


def _phrase(parts: list[str]) -> Phrase:
    if not parts:
        raise QueryError("an operand is missing")
    return Phrase("".join(parts))


def _clause(parts: list[str]):
    first, *excluded = _split(parts, "not")
    terms: list = []
    if first or not excluded:
        phrases = [_phrase(p) for p in _split(first, "or")]
        terms.append(phrases[0] if len(phrases) == 1 else Or(tuple(phrases)))
    terms.extend(Not(_phrase(p)) for p in excluded)
    return terms[0] if len(terms) == 1 else And(tuple(terms))


def parse(text: str):
    parts = lex(text)
    if not parts:
        raise QueryError("the query is empty")
    if len(parts) == 1 or not any(p.lower() in OPERATORS for p in parts):
        return Phrase(text)
    clauses = [_clause(p) for p in _split(parts, "and")]
    return clauses[0] if len(clauses) == 1 else And(tuple(clauses))


def read(text: str, kind: str = "l"):
    """A query by kind: ``l`` logic, ``m`` one phrase or wildcard, ``reg`` a regular expression, ``t`` a whole token."""
    return {"l": parse, "m": Phrase, "reg": Regex, "t": Token}[kind](text)


def matches(text: str, line: Column) -> Column:
    return parse(text).column(line)
