"""Paths, languages and names in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as source and as test, by extension and by pattern.
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte")
TEST_PATTERNS = (r"\.test\.", r"\.spec\.", "__tests__")
#: Extensions of files that paths in tool calls may name.
NAMED_EXTENSIONS = (".ts", ".tsx", ".py", ".rs", ".js", ".jsx", ".go", ".java", ".c", ".cpp", ".h", ".hpp")
#: Language ids of editors by extension.
EDITOR_LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescriptreact", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascriptreact", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".pyi": "python", ".go": "go", ".mod": "go", ".rs": "rust", ".json": "json", ".jsonc": "jsonc", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".md": "markdown", ".mdx": "markdown", ".css": "css", ".scss": "scss", ".html": "html", ".htm": "html", ".sh": "shellscript", ".bash": "shellscript", ".zsh": "shellscript",
    ".dockerfile": "dockerfile", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".lua": "lua",
}
#: Files whose whole name says their language.
NAMED_FILES = {"Dockerfile": "dockerfile"}
#: Languages of an index by extension; others go by the extension itself.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "rb": "ruby", "php": "php"}
#: Top folders that hold no code base, and files and folders that mark one.
SYSTEM_FOLDERS = ("dev", "sys", "proc", "etc", "usr", "var", "bin", "sbin", "private", "tmp", "lost+found")
MARKERS = (".git", ".pi", ".pi-cache", "package.json", "tsconfig.json", "jsconfig.json", "Cargo.toml", "go.mod", "pyproject.toml", "requirements.txt", "gemfile", "pom.xml", "build.gradle")
#: Declarations at the start of a hover text's line, in the order in which they are tried.
DECLARATIONS = (
    r"^\(method\)\s+([\w$]+)",
    r"^(?:async\s+)?function\s+([\w$]+)",
    r"^(?:export\s+)?(?:async\s+)?function\s+([\w$]+)",
    r"^(?:export\s+)?class\s+([\w$]+)",
    r"^(?:export\s+)?interface\s+([\w$]+)",
    r"^(?:export\s+)?type\s+([\w$]+)",
    r"^(?:export\s+)?enum\s+([\w$]+)",
    r"^(?:export\s+)?const\s+([\w$]+)",
    r"^(?:export\s+)?let\s+([\w$]+)",
    r"^(?:export\s+)?var\s+([\w$]+)",
    r"^\(property\)\s+([\w$]+)",
    r"^\(variable\)\s+([\w$]+)",
)
#: Names that a skeleton's line declares.
SKELETON_NAMES = (r"(?:export\s+)?(?:class|function|interface|type|enum|struct|trait|impl|pub fn|def|pub struct|pub enum)\s+(\w+)", r"^(?:class|def)\s+(\w+)")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]).getItem(key)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalized(path: Column) -> Column:
    """Slashes forward, '.' and empty parts gone, '..' resolved as far as it can be; an empty path stays empty."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = p.startswith("/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    nothing = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        back = (x == "..") & last.isNotNull() & (last != "..")
        return F.when(back, F.slice(done, F.lit(1), F.size(done) - 1)).when((x == "..") & rooted, done).otherwise(F.concat(done, F.array(x)))

    body = F.array_join(F.aggregate(parts, nothing, step), "/")
    end = F.when(p.endswith("/") & (body != ""), "/").otherwise("")
    return F.when(p == "", "").when((body == "") & ~rooted, F.when(p.endswith("/"), "./").otherwise(".")).otherwise(F.concat(F.when(rooted, "/").otherwise(""), body, end))


def extension(path: Column) -> Column:
    """The last dot of the base name and what follows; empty where it starts the name or is not there."""
    return F.regexp_extract(base_name(path), r"(?s)^(?!\.\.$).+(\.[^.]*)$", 1)


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def is_test(path: Column) -> Column:
    return path.rlike("|".join(TEST_PATTERNS))


def folder(path: Column) -> Column:
    """The folder of a relative path, null for a bare name."""
    return F.when(path.contains("/"), normalized(F.regexp_replace(path, "/+[^/]*$", "")))


def is_under(path: Column, root: Column) -> Column:
    a, b = normalized(path), F.regexp_replace(normalized(root), "/$", "")
    return (a == b) | a.startswith(F.concat(b, F.lit("/")))


def to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def from_uri(uri: Column) -> Column:
    return F.when(uri.startswith("file://"), F.url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))).otherwise(uri)


def language(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext == "", "unknown").otherwise(F.coalesce(_lookup(LANGUAGES, ext), ext))


def editor_language(path: Column) -> Column:
    """By extension, else by whole name, else null."""
    base = base_name(path)
    return F.coalesce(_lookup(EDITOR_LANGUAGES, F.lower(extension(path))), _lookup(NAMED_FILES, base), _lookup(NAMED_FILES, F.lower(base)))


def is_code_base(root: Column, entries: Column) -> Column:
    """Whether a folder with these entries (array) is one to index: no system folder, no bare home, with a marker."""
    parts = F.filter(F.split(normalized(root), "/"), lambda x: x != "")
    at = lambda i: F.lower(F.try_element_at(parts, i))
    drive = F.coalesce(at(F.lit(1)).rlike("^[a-z]:$"), F.lit(False))
    first = F.when(drive & (F.size(parts) > 1), at(F.lit(2))).otherwise(at(F.lit(1)))
    home = F.when(drive, at(F.lit(2))).otherwise(at(F.lit(1))).isin("users", "home")
    bare = F.coalesce(home, F.lit(False)) & (F.size(parts) < F.when(drive, 4).otherwise(3))
    return (F.size(parts) > 0) & ~first.isin(*SYSTEM_FOLDERS) & ~bare & F.arrays_overlap(entries, F.array(*map(F.lit, MARKERS)))


def _first_match(text: Column, patterns: tuple[str, ...], flags: str = "") -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, flags + p, 1), F.lit("")) for p in patterns])


def hover_symbol(text: Column) -> Column:
    """The symbol that the first line with a declaration declares, or null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.filter(F.transform(lines, lambda x: _first_match(x, DECLARATIONS, "(?i)")), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


def lookup_key(symbol: Column, path: Column) -> Column:
    """The symbol's trimmed name, else the file's stem."""
    stem = F.regexp_replace(base_name(path), r"\.[^.]+$", "")
    return F.coalesce(F.nullif(F.trim(symbol), F.lit("")), stem, symbol)


def skeleton_names(skeleton: Column) -> Column:
    names = F.transform(F.split(skeleton, "\n"), lambda x: _first_match(x, SKELETON_NAMES))
    return F.array_join(F.filter(names, lambda x: x.isNotNull()), ", ")


def suffixes(path: Column) -> Column:
    """The path and what remains of it without its first folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def cleaned(raw: Column) -> Column:
    """A path without quotes, brackets and punctuation around it."""
    return F.regexp_replace(F.regexp_replace(raw, r"^[\s@`\"'<(\[]+", ""), r"[\s`\"'>)\],;.]+$", "")


def message_text(blocks: Column) -> Column:
    """The texts of a message's content blocks, joined by blanks."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b.getField("text"), F.lit(""))), " ")


def injected_paths(context: Column) -> Column:
    """Paths that head the sections of an injected context."""
    return F.regexp_extract_all(context, F.lit("(?m)^### (.+)$"), F.lit(1))
