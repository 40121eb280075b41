"""The query language: lexer, parser and tree.

    expr   := term (OR term)*
    term   := factor (AND? factor)*
    factor := NOT? atom
    atom   := WORD | PHRASE | WORD ':' atom | '(' expr ')'

AND, OR and NOT are operators in any case. White space is the space and the tab.
A quote that isn't closed runs to the end and so does a group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import partial


class QueryError(ValueError):
    """The query can't be parsed."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Field:
    name: str
    child: object


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    children: tuple


@dataclass(frozen=True)
class Or:
    children: tuple


#: Blanks, or a sign, or a quoted phrase, or a word.
SCAN = re.compile(r'[ \t]+|(?P<sign>[():])|"(?P<phrase>[^"]*)"?|(?P<word>[^ \t():"]+)')
OPERATORS = {"AND", "OR", "NOT"}


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, text) tokens; kinds: ( ) : AND OR NOT PHRASE WORD."""
    out = []
    for m in SCAN.finditer(text):
        if m["sign"]:
            out.append((m["sign"], m["sign"]))
        elif m["word"]:
            out.append((m["word"].upper() if m["word"].upper() in OPERATORS else "WORD", m["word"]))
        elif m["phrase"] is not None:
            out.append(("PHRASE", m["phrase"]))
    return out


@dataclass
class _Group:
    """An open group: its alternatives, each a list of what must all match, and what waits
    for the next operand (a NOT, a field, or the group's own prefixes outside of it)."""

    alternatives: list[list] = field(default_factory=lambda: [[]])
    waiting: list = field(default_factory=list)
    joined: bool = False  # an AND has been read since the last operand

    def add(self, operand) -> None:
        while self.waiting:
            operand = self.waiting.pop()(operand)
        self.alternatives[-1].append(operand)
        self.joined = False

    def tree(self):
        each = [a[0] if len(a) == 1 else And(tuple(a)) for a in self.alternatives]
        return each[0] if len(each) == 1 else Or(tuple(each))


def parse(text: str):
    """The tree of a query; QueryError for leftovers and missing operands.

    One pass over the tokens with a stack of open groups. After NOT and after a
    field's colon any token but an opening one is an operand. One AND joins, or leads or trails to no effect; a second
    one is a word.
    """
    tokens, groups, at = lex(text), [_Group()], 0
    while at < len(tokens):
        (kind, word), now = tokens[at], groups[-1]
        at += 1
        bare = not now.waiting
        if kind == "(":
            groups.append(_Group())
        elif kind == "PHRASE":
            now.add(Phrase(tuple(word.split())))
        elif kind == "WORD" and tokens[at : at + 1] == [(":", ":")]:
            now.waiting.append(partial(Field, word))
            at += 1
        elif bare and kind == "NOT":
            now.waiting.append(Not)
        elif bare and kind == "OR":
            now.alternatives.append([])
            now.joined = False
        elif bare and kind == "AND" and not now.joined:
            now.joined = True
        elif bare and kind == ")":
            if len(groups) == 1:
                raise QueryError(f"unexpected {word!r}")
            groups.pop()
            groups[-1].add(now.tree())
        else:
            now.add(Term(word))
    while True:
        if groups[-1].waiting:
            raise QueryError("the query ends where a term is expected")
        last = groups.pop()
        if not groups:
            return last.tree()
        groups[-1].add(last.tree())
