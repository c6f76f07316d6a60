"""Source files to rows: signatures, imports, exports and content hash, by language."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.paths import LANGUAGES
from .tokens import BEFORE_OPERAND, Token, angles, matched, rust, script, type_end

FILE_INDEX = "path string, language string, skeleton string, imports array<string>, exports array<string>, content_hash string"
Parsed = tuple[list[str], list[str], list[str]]


def python_file(text: str) -> Parsed:
    """Signatures of functions, indented four a class level, and classes; only relative imports are listed."""
    lines, imports, exports = [], [], []

    def visit(body: list[ast.stmt], depth: int) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
                back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
                lines.append(f"{'    ' * depth}{word} {node.name}({ast.unparse(node.args)}){back}: ...")
                if not depth:
                    exports.append(node.name)
            elif isinstance(node, ast.ClassDef):
                bases = ", ".join(map(ast.unparse, node.bases))
                lines.append(f"{'    ' * depth}class {node.name}{f'({bases})' if bases else ''}:")
                if not depth:
                    exports.append(node.name)
                visit(node.body, depth + 1)
            elif isinstance(node, ast.ImportFrom) and node.level:
                imports.append("." * node.level + (node.module or ""))

    visit(ast.parse(text).body, 0)
    return lines, imports, exports


#: Tokens after which a statement may begin on the same line.
BEFORE_STATEMENT = frozenset("; { } else do export default declare".split())


def begins_statement(tokens: list[Token], i: int) -> bool:
    last = tokens[i - 1] if i else None
    if last is None or last.text in BEFORE_STATEMENT:
        return True
    return last.text == ")" or tokens[i].fresh and (last.word and last.text not in BEFORE_OPERAND or last.text[0] in "\"'`0123456789]/<>")


def script_declaration(tokens: list[Token], ends: dict[int, int], i: int) -> tuple[int, int, str, bool] | None:
    """(place of the body or end of the signature, place after all, name, has a body) of a declaration that begins at i."""
    at = lambda k: tokens[k].text if k < len(tokens) else ""
    named = lambda k: k < len(tokens) and tokens[k].word
    while at(i) == "@" and named(i + 1):
        i += 2
        while at(i) == "." and named(i + 1):
            i += 2
        i = ends[i] if at(i) == "(" else i
    k = i + (at(i) in ("async", "abstract") or at(i) == "const" and at(i + 1) == "enum")
    kind = at(k)
    if kind not in ("function", "class", "interface", "type", "enum") or not named(k + 1) or (at(i) == "async" and kind != "function") or (at(i) == "abstract" and kind != "class"):
        return None
    name, k = at(k + 1), angles(tokens, ends, k + 2)
    if kind == "function":
        if at(k) != "(":
            return None
        k = ends[k]
        k = type_end(tokens, ends, k + 1) if at(k) == ":" else k
        return (k, ends[k], name, True) if at(k) == "{" else (k, k, name, False)
    if kind == "type":
        if at(k) != "=":
            return None
        stop = type_end(tokens, ends, k + 1)
        whole = at(k + 1) == "{" and ends[k + 1] == stop
        return k + 1 if whole else stop, stop, name, whole
    while k < len(tokens) and at(k) != "{":
        if at(k) in (";", "=", ":", ")", "}"):
            return None
        k = angles(tokens, ends, k) if at(k) == "<" else ends.get(k, k + 1)
    return (k, ends[k], name, True) if at(k) == "{" else None


def typescript_file(text: str, jsx: bool = False) -> Parsed:
    """Declarations that stand in no other one, up to their bodies as `{ ... }`; exported or not they are listed, generators
    are not; imports from import statements."""
    tokens = script(text, jsx)
    ends = matched(tokens)
    lines, imports, exports = [], [], []
    i = done = 0
    while i < len(tokens):
        t, after = tokens[i], tokens[i + 1].text if i + 1 < len(tokens) else ""
        if not (i == done or begins_statement(tokens, i)) or not (t.word or t.text == "@"):
            i += 1
            continue
        if t.text == "import" and after not in ("(", "."):
            stop = i + 1
            while stop < len(tokens) and tokens[stop].text[0] not in "\"';=" and not (tokens[stop].fresh and tokens[stop].text in ("import", "export")):
                stop += 1
            if stop < len(tokens) and tokens[stop].text[0] in "\"'":
                imports.append(tokens[stop].text[1:-1])
                stop += 1
            i = stop
            continue
        start = i
        if t.text == "export":
            start += 1 + (after == "default")
        found = script_declaration(tokens, ends, start) if start < len(tokens) else None
        if found is None:
            i += 1
            continue
        body, stop, name, has_body = found
        head = text[tokens[start].start : tokens[body].start if has_body else tokens[body - 1].end].rstrip()
        lines.append(("export " if t.text == "export" else "") + head + (" { ... }" if has_body else ""))
        exports.append(name)
        i = done = stop
    return lines, imports, exports


RUST_KINDS = frozenset("fn struct enum trait impl type".split())
RUST_BEFORE = frozenset("pub async unsafe const extern default".split())


def rust_file(text: str) -> Parsed:
    """Items up to their bodies, those inside impl and trait blocks too; a module is an export and the import mod:x, whatever
    it holds; uses of crate and super only."""
    tokens = rust(text)
    ends = matched(tokens)
    lines, imports, exports, mods = [], [], [], []
    at = lambda k: tokens[k].text if k < len(tokens) else ""
    i = 0
    while i < len(tokens):
        if at(i) == "#" and at(i + 1) in ("[", "!"):
            k = i + 1 + (at(i + 1) == "!")
            i = ends[k] if at(k) == "[" else k
            continue
        if i and at(i - 1) not in (";", "{", "}", "]"):
            i += 1
            continue
        start = i
        k = i
        while at(k) in RUST_BEFORE:
            k = ends[k + 1] if at(k) == "pub" and at(k + 1) == "(" else k + 1
            k += at(k - 1) == "extern" and at(k)[:1] == '"'
        if at(k) == "mod" and at(k + 2) in (";", "{"):
            imports.append(f"mod:{at(k + 1)}")
            mods.append(at(k + 1))
            i = ends.get(k + 2, k + 3)
        elif at(k + 1) == "!":
            # what a macro is given or makes is no item yet
            k += 2 + (at(k) == "macro_rules")
            i = ends.get(k, k + 1)
        elif at(k) == "use":
            stop = k
            while stop < len(tokens) and at(stop) != ";":
                stop = ends.get(stop, stop + 1)
            said = text[tokens[k + 1].start : tokens[stop - 1].end] if stop > k + 1 else ""
            if said.startswith(("crate::", "super::")):
                imports.append(said)
            i = stop + 1
        elif at(k) in RUST_KINDS:
            stop = k + 1
            while stop < len(tokens) and at(stop) not in ("{", ";", "}"):
                stop = ends.get(stop, stop + 1)
            has_body = at(stop) == "{"
            lines.append(text[tokens[start].start : tokens[stop - 1].end].rstrip() + (" { ... }" if has_body else ";"))
            if at(k) != "impl":
                exports.append(at(k + 1))
            i = ends[stop] if has_body and at(k) not in ("impl", "trait") else stop + 1
        else:
            i += 1
    return lines, imports, exports + mods


PARSERS: dict[str, Callable[[str], Parsed]] = {}


def register(extensions: str, parser: Callable[[str], Parsed]) -> None:
    for e in extensions.split():
        PARSERS[e] = parser


register("ts mts cts", typescript_file)
register("tsx js jsx", lambda text: typescript_file(text, jsx=True))
register("py pyi", python_file)
register("rs", rust_file)


def language_of(path: str) -> str:
    """As functions.paths.language has it."""
    ext = path.rpartition(".")[2].lower()
    return LANGUAGES.get(ext, ext) or "unknown"


def candidates(path: str, raw: str) -> list[str]:
    """Paths that an import of a file may mean, best first."""
    folder = path.rpartition("/")[0]

    def at(rel: str) -> str:
        parts: list[str] = []
        for p in f"{folder}/{rel}".split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in ("", "."):
                parts.append(p)
        return "/".join(parts)

    ext = path.rpartition(".")[2]
    if ext in ("py", "pyi"):
        dots = len(raw) - len(raw.lstrip("."))
        return [at("../" * (dots - 1) + raw.lstrip(".").replace(".", "/") + ".py")] if raw.lstrip(".") else []
    if ext == "rs":
        if raw.startswith("mod:"):
            return [at(f"{raw[4:]}.rs"), at(f"{raw[4:]}/mod.rs")]
        rest = raw.split("::")[1:]
        return [at("/".join(rest[:n]) + end) for n in range(len(rest), 0, -1) for end in (".rs", "/mod.rs")]
    if not raw.startswith("."):
        return []
    base = at(raw)
    return [base + end for end in (".ts", ".tsx", "/index.ts", "/index.tsx", "")] + ([base[:-3] + ".ts"] if base.endswith(".js") else [])


def parse_files(files: DataFrame, cached: DataFrame | None = None, by: str = "path") -> DataFrame:
    """FILE_INDEX of (path, content): files with a parser for the extension of column `by`; one whose hash the cache has is
    not parsed again, and one that fails to parse keeps its last good row, or goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                text = r.content or ""
                said = hashlib.sha256(text.encode()).hexdigest()
                old = getattr(r, "old_hash", None)
                row = None
                if old != said:
                    try:
                        lines, imports, exports = PARSERS[getattr(r, by).rpartition(".")[2]](text)
                        row = (r.path, language_of(getattr(r, by)), "\n".join(lines), imports, exports, said)
                    except (SyntaxError, ValueError, RecursionError):
                        row = None
                if row is None and isinstance(old, str):
                    row = (r.path, language_of(getattr(r, by)), r.old_skeleton, list(r.old_imports), list(r.old_exports), old)
                if row:
                    rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "language", "skeleton", "imports", "exports", "content_hash"])

    known = files.filter(f"substring_index({by}, '.', -1) IN ('" + "', '".join(PARSERS) + "')")
    if cached is not None:
        old = cached.selectExpr("path", "skeleton AS old_skeleton", "imports AS old_imports", "exports AS old_exports", "content_hash AS old_hash")
        known = known.join(old, "path", "left")
    return known.mapInPandas(run, FILE_INDEX)
