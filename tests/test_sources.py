from skeinwork.operators import retrieval
from skeinwork.sources import parsers, store

TS = """import { x } from './models'
import type { Y } from "lib"
export async function login(user: string): Promise<void> {
  function inner() {}
}
export class Service extends Base { run() { return '{' } }
interface Options { a: number }
export type Id = string | number;
// class Ghost {}
"""
RS = "mod util;\nuse crate::core::run;\nuse std::io;\npub struct A { x: u8 }\nimpl A { fn go(&self) -> u8 { 1 } }\npub fn free<T>(t: T) -> T { t }\n"


def test_parsers():
    lines, imports, exports = parsers.typescript_file(TS)
    assert lines == ["export async function login(user: string): Promise<void> { ... }", "export class Service extends Base { ... }", "interface Options { ... }", "export type Id = string | number"]
    assert (imports, exports) == (["./models", "lib"], ["login", "Service", "Options", "Id"])
    lines, imports, exports = parsers.rust_file(RS)
    assert lines == ["pub struct A { ... }", "impl A { ... }", "fn go(&self) -> u8 { ... }", "pub fn free<T>(t: T) -> T { ... }"]
    assert (imports, exports) == (["mod:util", "crate::core::run"], ["A", "go", "free", "util"])
    lines, imports, exports = parsers.python_file("from .a import b\nimport os\nclass A(B):\n    def f(self, x=1) -> int: return 1\nasync def g(): pass\n")
    assert lines == ["class A(B):", "    def f(self, x=1) -> int: ...", "async def g(): ..."]
    assert (imports, exports) == ([".a"], ["A", "g"])
    assert parsers.candidates("src/a/b.ts", "../c")[0] == "src/c.ts"
    assert parsers.candidates("p/q/r.py", "..x.y") == ["p/x/y.py"]


def test_scan_parse_store(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/foo.ts": "import { b } from './bar'\nexport function foo() {}", "src/bar.ts": "export class Bar {}", "node_modules/x.ts": "export class No {}", "src/bad.py": "def (", "src/gen/a.ts": "export class Gen {}"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = store.scan(spark, str(root), ["ts", "py"], patterns=("gen/",))
    index = parsers.parse_files(files)
    rows = {r.path: r for r in index.collect()}
    assert set(rows) == {"src/foo.ts", "src/bar.ts"} and rows["src/foo.ts"].exports == ["foo"]
    again = {r.path: r for r in parsers.parse_files(files, index).collect()}
    assert again == rows
    imports = spark.createDataFrame([(p, i, parsers.candidates(p, i)) for p, r in rows.items() for i in r.imports], "src string, raw string, candidates array<string>")
    assert [tuple(r) for r in retrieval.resolve_imports(imports, index.select("path")).collect()] == [("src/foo.ts", "src/bar.ts")]
    at = str(tmp_path / "store")
    assert not store.exists(spark, at)
    store.save({"files": index}, at, root=str(root))
    assert store.exists(spark, at)
    assert "added" in store.load(spark, at, {"files": {"added": 1}})["files"].columns


def test_recent_sessions(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"session_id":"a","total_tokens_saved":100}\nnot json\n\n{"session_id":"b","total_tokens_saved":200}\n{"session_id":"c","total_tokens_saved":300}\n')
    assert [r.session_id for r in store.recent_sessions(spark, str(tmp_path), 2).collect()] == ["c", "b"]
