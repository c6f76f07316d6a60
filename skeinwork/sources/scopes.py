"""Names of TypeScript files: where each is declared, over which part of the file that holds, what is imported, and where names stand."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

from .parsers import begins_statement
from .tokens import CLOSE, Token, angles, matched, script, type_end

NAMES = "path string, kind string, symbol string, at long, start long, end long, source string, original string"
KEYWORDS = frozenset("const let var function class enum interface type import export from as default return if else for while do switch case break continue new this super typeof instanceof in of void delete throw try catch finally async await yield static public private protected readonly abstract extends implements declare namespace module true false null undefined any string number boolean never unknown object keyof is asserts get set".split())
BLOCK_HEADS = frozenset("if for while switch catch with".split())


class Name(NamedTuple):
    """kind: declared (holds from start to end), imported (from source, as original there) or used; at is the name's place."""

    kind: str
    symbol: str
    at: int
    start: int = 0
    end: int = 0
    source: str | None = None
    original: str | None = None


def bound_words(tokens: list[Token], ends: dict[int, int], begin: int, stop: int) -> list[int]:
    """Places of the names that a list of parameters or a pattern binds."""
    out, k = [], begin
    while k < stop:
        t, before = tokens[k], tokens[k - 1].text
        if t.text in ("{", "["):
            out += bound_words(tokens, ends, k + 1, ends[k] - 1)
            k = ends[k]
            if k < stop and tokens[k].text == ":" and tokens[begin - 1].text == "(":
                k = type_end(tokens, ends, k + 1)
        elif t.word and before in ("(", ",", "{", "[", ".", "...", ":") and not (k + 1 < stop and tokens[k + 1].text == ":" and tokens[begin - 1].text == "{"):
            out.append(k)
            k += 1
            if k < stop and tokens[k].text == "?":
                k += 1
            if k < stop and tokens[k].text == ":":
                k = type_end(tokens, ends, k + 1)
            # a default value binds nothing
            while k < stop and tokens[k].text != ",":
                k = ends.get(k, k + 1)
        else:
            k += 1
    return out


def names_in(text: str) -> list[Name]:
    tokens = script(text)
    ends = matched(tokens)
    closes = lambda i: tokens[ends[i] - 1].end if ends[i] <= len(tokens) else len(text)
    at = lambda k: tokens[k].text if 0 <= k < len(tokens) else ""
    opened = {end: i for i, end in ends.items()}
    out: list[Name] = []
    said: set[int] = set()
    stops: dict[int, int] = {}
    # (start, end, whether it is a function's), the file first
    scopes: list[tuple[int, int, bool]] = [(0, len(text) + 1, True)]

    def declare(k: int, scope: tuple[int, int, bool]) -> None:
        said.add(k)
        out.append(Name("declared", at(k), tokens[k].start, scope[0], scope[1]))

    def body_of(k: int) -> tuple[int, int, bool] | None:
        """The scope of the function whose parameters end before k."""
        if at(k) == ":":
            k = type_end(tokens, ends, k + 1)
        arrow = at(k) == "=>"
        k += arrow
        if at(k) == "{":
            return tokens[k].start, closes(k), True
        if not arrow or k >= len(tokens):
            return None
        # an expression ends where those end that it stands in, so each place is walked over once
        start, walked = k, []
        while k < len(tokens) and k not in stops and at(k) not in (",", ";", ")", "]", "}"):
            walked.append(k)
            k = ends.get(k, k + 1)
        k = stops.get(k, k)
        stops.update(dict.fromkeys(walked, k))
        return tokens[start].start, tokens[min(k, len(tokens)) - 1].end, True

    def is_method(k: int) -> bool:
        """Whether the bracket at k holds the parameters of a method that is defined there."""
        if at(k) != "(" or k == 0 or not tokens[k - 1].word or at(k - 1) in BLOCK_HEADS or "function" in (at(k - 1), at(k - 2)):
            return False
        after = ends[k]
        return at(after) == "{" or at(after) == ":" and at(type_end(tokens, ends, after + 1)) == "{"

    def arrow_of(k: int) -> int | None:
        """The place of the arrow after the parameters in the bracket at k, a return type aside."""
        after = ends[k]
        if at(after) == ":":
            after += 1
            while after < len(tokens) and at(after) not in ("=>", ",", ";", ":", ")", "]", "}"):
                after = ends.get(after, after + 1)
        return after if at(after) == "=>" else None

    i = 0
    while i < len(tokens):
        t = tokens[i]
        while len(scopes) > 1 and t.start >= scopes[-1][1]:
            scopes.pop()
        if t.text == "import" and at(i + 1) not in ("(", ".") and at(i - 1) != ".":
            k = i + 1
            while k < len(tokens) and at(k)[0] not in "\"';":
                k += 1
            source = at(k)[1:-1] if k < len(tokens) and at(k)[0] in "\"'" else None
            for j in range(i + 1, k):
                if tokens[j].word and at(j) not in ("type", "from", "as") and at(j + 1) != "as":
                    whole = at(j - 1) == "as" and at(j - 2) == "*"
                    original = "*" if whole else at(j - 2) if at(j - 1) == "as" else at(j) if opened_list(tokens, i, j) else "default"
                    out.append(Name("imported", at(j), tokens[j].start, source=source, original=original))
            said.update(range(i, k + 1))
            i = k + 1
            continue
        if t.text == "{":
            head = opened.get(i)
            function = at(i - 1) == "=>" or at(i - 1) == ")" and head is not None and at(head - 1) not in BLOCK_HEADS
            scopes.append((t.start, closes(i), function))
        elif t.text in ("const", "let", "var") and at(i - 1) != ".":
            scope = next(s for s in reversed(scopes) if s[2]) if t.text == "var" else scopes[-1]
            k = i + 1
            while k < len(tokens):
                if at(k) in ("{", "["):
                    for j in bound_words(tokens, ends, k + 1, ends[k] - 1):
                        declare(j, scope)
                elif tokens[k].word:
                    declare(k, scope)
                # to the next name of the statement, if there is one
                k = ends.get(k, k + 1)
                while k < len(tokens) and at(k) not in (",", ";", ")", "}", "in", "of") and not (tokens[k].fresh and begins_statement(tokens, k)):
                    k = ends.get(k, k + 1)
                if at(k) != "," or at(k + 1) in ("const", "let", "var"):
                    break
                k += 1
        elif t.text in ("function", "class", "enum", "interface", "type") and at(i - 1) != ".":
            k = i + 1 + (at(i + 1) == "*")
            if k < len(tokens) and tokens[k].word and (t.text != "type" or at(k + 1) in ("=", "<")):
                declare(k, scopes[-1])
                k += 1
            k = angles(tokens, ends, k)
            if t.text == "function" and at(k) == "(" and (scope := body_of(ends[k])):
                for j in bound_words(tokens, ends, k + 1, ends[k] - 1):
                    declare(j, scope)
        elif t.text == "(" and (is_method(i) or arrow_of(i) is not None):
            if scope := body_of(ends[i] if is_method(i) else arrow_of(i)):
                for j in bound_words(tokens, ends, i + 1, ends[i] - 1):
                    declare(j, scope)
        elif t.word and at(i + 1) == "=>" and at(i - 1) != ":" and (scope := body_of(i + 1)):
            declare(i, scope)
        if t.word and i not in said and t.text not in KEYWORDS and not t.text[0].isdigit() and at(i - 1) != "." and not is_method(i + 1) and not (at(i + 1) == ":" and at(i - 1) in ("{", ",")):
            out.append(Name("used", t.text, t.start))
        i += 1
    return out


def opened_list(tokens: list[Token], begin: int, k: int) -> bool:
    """Whether place k stands inside braces that open after begin."""
    return any(t.text == "{" for t in tokens[begin:k]) and CLOSE["{"] not in (t.text for t in tokens[begin:k])


def names_of_files(files: DataFrame) -> DataFrame:
    """NAMES of (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(path, *n) for path, text in zip(pdf.path, pdf.content, strict=True) for n in names_in(text or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "symbol", "at", "start", "end", "source", "original"])

    # texts are dealt out, as a table of few parts would keep few tasks busy
    return files.select("path", "content").repartition("path").mapInPandas(run, NAMES)
