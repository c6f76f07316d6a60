"""Tokens of TypeScript and Rust files, with brackets matched, and where declarations end.

A token is (text, start, end, first on its line); comments go, and a string, template,
regular expression or JSX element is one token whatever stands in it.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    text: str
    start: int
    end: int
    fresh: bool

    @property
    def word(self) -> bool:
        return self.text[0].isalpha() or self.text[0] in "_$#"


BLANK = r"(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
SCRIPT = re.compile(BLANK + r"|(?P<token>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|[#]?[\w$]+|=>|\.\.\.|.)", re.DOTALL)
REGULAR = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Raw strings, byte strings and characters; a lifetime is a quote and a name without a closing quote.
RUST = re.compile(r"(?P<blank>\s+|//[^\n]*)|(?P<token>[bc]?r(?P<hash>#*)\".*?\"(?P=hash)|[bc]?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\(?:u\{[^}]*\}|.[0-9a-fA-F]?)|[^'\\])'|'\w+|\w+|->|=>|::|.)", re.DOTALL)
#: Words after which an operand follows, so that / begins a regular expression and < an element.
BEFORE_OPERAND = frozenset("return typeof case in of do else void delete throw new await yield default instanceof extends".split())


def script(text: str, jsx: bool = False) -> list[Token]:
    out: list[Token] = []
    heads: list[str] = []
    at, fresh = 0, True
    condition = False
    while at < len(text):
        m = SCRIPT.match(text, at)
        if m["blank"]:
            fresh = fresh or "\n" in m[0]
            at = m.end()
            continue
        last = out[-1] if out else None
        operand = last is None or (last.text in BEFORE_OPERAND if last.word else not (last.text[0] in "\"'`0123456789]/<" or last.text == ")" and not condition))
        c, end = m["token"], m.end()
        if c == "`":
            end = template(text, at)
        elif c == "/" and operand and (r := REGULAR.match(text, at)):
            end = r.end()
        elif c == "<" and jsx and operand and re.match(r"<(?:>|[\w$.:-]+(?:\s+(?!extends\b)[\w$:-]+\s*[=/>{]|\s*\{|\s*/?>))", text[at : at + 400]):
            end = element(text, at)
        if c == "(":
            heads.append(last.text if last else "")
        elif c == ")":
            condition = heads.pop() in ("if", "while", "for", "with") if heads else False
        out.append(Token(text[at:end], at, end, fresh))
        at, fresh = end, False
    return out


def template(text: str, at: int) -> int:
    """Where the template that begins at `at` ends; what stands in ${} is code of its own."""
    at += 1
    while at < len(text) and text[at] != "`":
        at = braces(text, at + 1) if text.startswith("${", at) else at + 1 + (text[at] == "\\")
    return at + 1


def braces(text: str, at: int, jsx: bool = False) -> int:
    """Where the code in braces that begins at `at` ends."""
    depth = 0
    while at < len(text):
        m = SCRIPT.match(text, at)
        c = m["token"]
        if c == "`":
            at = template(text, at)
            continue
        if c == "<" and jsx and re.match(r"<[A-Za-z>]", text[at : at + 2]) and re.search(r"(?:[(=?:,&|{>]|\breturn)\s*$", text[max(0, at - 80) : at]):
            at = element(text, at)
            continue
        depth += (c == "{") - (c == "}")
        at = m.end()
        if c == "}" and not depth:
            break
    return at


def element(text: str, at: int) -> int:
    """Where the JSX element that begins at `at` ends."""
    depth = 0
    while at < len(text):
        if text[at] == "{":
            at = braces(text, at, True)
        elif text[at] == "<":
            closing = text.startswith("</", at)
            at += 1
            while at < len(text) and text[at] != ">":
                q = text[at]
                at = braces(text, at, True) if q == "{" else (text.find(q, at + 1) + 1 or len(text)) if q in "\"'" else at + 1
            depth += -1 if closing else text[at - 1 : at] != "/"
            at += 1
            if depth <= 0:
                return at
        else:
            at += 1
    return at


def rust(text: str) -> list[Token]:
    out: list[Token] = []
    at, fresh = 0, True
    while at < len(text):
        if text.startswith("/*", at):
            # block comments nest
            depth, at = 1, at + 2
            while depth and at < len(text):
                step = 1 if text.startswith("/*", at) else -1 if text.startswith("*/", at) else 0
                depth, at = depth + step, at + (2 if step else 1)
            continue
        m = RUST.match(text, at)
        if m["blank"]:
            fresh = fresh or "\n" in m[0]
        else:
            out.append(Token(m["token"], at, m.end(), fresh))
            fresh = False
        at = m.end()
    return out


CLOSE = {"(": ")", "[": "]", "{": "}"}


def matched(tokens: list[Token]) -> dict[int, int]:
    """The place after the bracket that closes each opening one; the end where none does."""
    out, held = {}, []
    for i, t in enumerate(tokens):
        if t.text in CLOSE:
            held.append(i)
        elif t.text in (")", "]", "}"):
            while held:
                j = held.pop()
                out[j] = i + 1
                if CLOSE[tokens[j].text] == t.text:
                    break
    return out | dict.fromkeys(held, len(tokens))


def angles(tokens: list[Token], ends: dict[int, int], i: int) -> int:
    """The place after type parameters that begin at i; i where none do."""
    depth = 0
    while i < len(tokens):
        c = tokens[i].text
        if c not in ("<", ">") and not depth:
            break
        depth += (c == "<") - (c == ">")
        i = ends.get(i, i + 1)
        if c == ">" and not depth:
            break
    return i


#: What a type goes on with on both sides.
TYPE_JOINS = frozenset("| & => ? : . = keyof typeof readonly extends infer is asserts unique in".split())


def type_end(tokens: list[Token], ends: dict[int, int], i: int) -> int:
    """The place after a type expression that begins at i."""
    operand = True
    while i < len(tokens):
        t = tokens[i]
        if t.text in TYPE_JOINS:
            operand, i = True, i + 1
        elif t.text == "<":
            operand, i = False, angles(tokens, ends, i)
        elif operand:
            operand, i = False, ends.get(i, i + 1)
        elif not t.fresh and (t.text == "[" or t.text == "(" and tokens[i - 1].text == "import"):
            i = ends[i]
        else:
            break
    return i
