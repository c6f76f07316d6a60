"""Names and scopes of TypeScript files, and what they resolve to, against loops."""

from skeinwork.operators import navigation
from skeinwork.sources import scopes

TEXT = """import d, { a as b, c } from './m'
import * as ns from "n"
const x = 1
export function f(x, { y, z: w = 3 }: T, ...rest: string[]) {
  var v = x
  if (v) { let x = 2; var late = x + y }
  return [1].map(q => q + x).filter((k: number): boolean => { const x = k; return x > w })
}
class K { m(p): void { return p + x + this.x + b + ns.x } }
const g = { x: x, y: gone, f(u) { return late } }
const [h, { i: j }] = g, s = `${x}`
"""


def line(at):
    return TEXT[:at].count("\n") + 1


def test_names():
    names = scopes.names_in(TEXT)
    assert [(n.symbol, n.source, n.original) for n in names if n.kind == "imported"] == [("d", "./m", "default"), ("b", "./m", "a"), ("c", "./m", "c"), ("ns", "n", "*")]
    assert [(n.symbol, line(n.at), line(n.start), line(n.end)) for n in names if n.kind == "declared"] == [("x", 3, 1, 12), ("f", 4, 1, 12), ("x", 4, 4, 8), ("y", 4, 4, 8), ("w", 4, 4, 8), ("rest", 4, 4, 8), ("v", 5, 4, 8), ("x", 6, 6, 6), ("late", 6, 4, 8), ("q", 7, 7, 7), ("k", 7, 7, 7), ("x", 7, 7, 7), ("K", 9, 1, 12), ("p", 9, 9, 9), ("g", 10, 1, 12), ("u", 10, 10, 10), ("h", 11, 1, 12), ("j", 11, 1, 12), ("s", 11, 1, 12)]
    used = [(n.symbol, line(n.at)) for n in names if n.kind == "used" and n.symbol != "T"]
    assert used == [("x", 5), ("v", 6), ("x", 6), ("y", 6), ("q", 7), ("x", 7), ("k", 7), ("x", 7), ("w", 7), ("p", 9), ("x", 9), ("b", 9), ("ns", 9), ("x", 10), ("gone", 10), ("late", 10), ("g", 11)]


def test_definitions(spark):
    files = {"t": TEXT, "m": "const pad = 0, other = 1\nexport const a = 1\n", "o": "function gone() {}\nconst x = 5", "p": "enum late {}", "q": "let late"}
    names = [(path, *n) for path, text in files.items() for n in scopes.names_in(text)]
    want = {}
    for path, kind, symbol, at, *_ in names:
        if kind == "used":
            held = [(n[4], -n[5], n[3]) for n in names if n[0] == path and n[1] == "declared" and n[2] == symbol and n[4] <= at < n[5]]
            if held:
                want[path, symbol, at] = ("scope", path, max(held)[2])
    place = {(n[0], n[2]): n[3] for n in names if n[1] == "declared" and n[4] == 0}
    at = {s: next(n[3] for n in names if n[:3] == ("t", "used", s)) for s in ("b", "gone")}
    want["t", "b", at["b"]] = ("import", "m", place["m", "a"])
    want["t", "gone", at["gone"]] = ("index", "o", place["o", "gone"])
    df = spark.createDataFrame(names, scopes.NAMES)
    got = navigation.scoped_definitions(df, spark.createDataFrame([("t", "./m", "m")], "path string, source string, target string")).collect()
    assert {(r.path, r.symbol, r.at): (r.how, r.target, r.target_at) for r in got} == want and len(got) == len(want) > 14
