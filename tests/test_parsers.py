"""Declarations in texts that regular expressions over lines get wrong."""

import random

import pytest

from skeinwork.sources import parsers, tokens

ts = parsers.typescript_file
tsx = parsers.PARSERS["tsx"]
TS = [
    ("export function greet(name: string): string {\n  return 'Hello ' + name\n}\n", ["export function greet(name: string): string { ... }"]),
    ("export class Agent {\n  private name: string\n  constructor(name: string) { this.name = name }\n  run(): void { console.log(this.name) }\n}\n", ["export class Agent { ... }"]),
    ("export interface Config {\n  name: string\n  timeout: number\n}\n", ["export interface Config { ... }"]),
    ("export type Status = 'idle' | 'running' | 'done'\n", ["export type Status = 'idle' | 'running' | 'done'"]),
    ("type A = { x: number }\ntype B = { x: number } & A\nlet x = 1", ["type A = { ... }", "type B = { x: number } & A"]),
    ("type C<T> =\n  | T extends string ? 'a' : never\n  | { [K in keyof T]: () => void }[]\nfunction next() {}", ["type C<T> =\n  | T extends string ? 'a' : never\n  | { [K in keyof T]: () => void }[]", "function next() { ... }"]),
    ("const a = `function no() { ${ [1].map(x => `}${x}{`) } } class No {`\nclass Yes {}", ["class Yes { ... }"]),
    ("const re = /[/'\"`{]\\/ function x() {/g, half = a / b / c\nclass Yes {}", ["class Yes { ... }"]),
    ("if (ok) /'/.test(s)\nfunction yes() {}\nconst n = f(x) / 2; const s = '/';", ["function yes() { ... }"]),
    ("@Component({ selector: 'x', text: `{` })\n@Other\nexport class Ui {}\n@Third() class Own {}", ["export class Ui { ... }", "@Third() class Own { ... }"]),
    ("export function many<\n  K extends { a: number },\n  V = Map<string, Array<K>>,\n>(k: K, v: V): { out: V } | undefined {\n  return\n}", ["export function many<\n  K extends { a: number },\n  V = Map<string, Array<K>>,\n>(k: K, v: V): { out: V } | undefined { ... }"]),
    ("function f(a: string): void\nfunction f(a: number): void\nfunction f(a: any) { }", ["function f(a: string): void", "function f(a: number): void", "function f(a: any) { ... }"]),
    ("export default async function main() {}\nexport default function () {}\nexport default class {}", ["export async function main() { ... }"]),
    ("declare function d(x: number): string;\nexport abstract class Base<T> extends mix({ a: 1 }) implements X<{ y: 1 }> { abstract run(): void }", ["declare function d(x: number): string".removeprefix("declare "), "export abstract class Base<T> extends mix({ a: 1 }) implements X<{ y: 1 }> { ... }"]),
    ("const enum E { A }\nenum F { B = 1 }", ["const enum E { ... }", "enum F { ... }"]),
    ("function* gen() { function inner() {} }\nconst f = function named() { class Deep {} }\nconst o = { type: 1, class: 2, function: 3 }\ntype = 4", ["function inner() { ... }", "class Deep { ... }"]),
    ("namespace N { export function inside() {} }\nexport namespace M { interface I {} }", ["export function inside() { ... }", "interface I { ... }"]),
    ("const run = () => {\n  function helper(x = { a: '}' }) { return 1 }\n  return helper\n}", ["function helper(x = { a: '}' }) { ... }"]),
    ("// class No {}\n/* function no() {} */ class Yes { } // export class No {}", ["class Yes { ... }"]),
    ("type Fn = (a: { b: 1 }) => Promise<void>;\ntype G = typeof import('x')\nclass Z {}", ["type Fn = (a: { b: 1 }) => Promise<void>", "type G = typeof import('x')", "class Z { ... }"]),
    ("function is(x: any): x is { a: 1 } { return true }\nfunction as(x: any): asserts x is string {}", ["function is(x: any): x is { a: 1 } { ... }", "function as(x: any): asserts x is string { ... }"]),
    ("", []),
    ("function (", []),
    ("class {{{ function f() {", ["function f() { ... }"]),
]


@pytest.mark.parametrize(("text", "want"), TS)
def test_typescript(text, want):
    assert ts(text)[0] == want


def test_typescript_imports():
    text = "import { bar } from './bar'\nimport d, * as n from \"../utils/baz\"\nimport type {\n  T,\n} from 'types'\nimport 'side'\nimport r = require('no')\nexport { x } from './re'\nconst lazy = import('no'); const m = import.meta.url\nimport json from './a.json' with { type: 'json' }"
    assert ts(text)[1] == ["./bar", "../utils/baz", "types", "side", "./a.json"]


def test_elements():
    text = "export const App = () => (\n  <div title='a\"b' {...rest} on={() => { return <b>it's {`}`}</b> }}>\n    don't function no() {1} class No <br/> <></>\n  </div>\n)\nexport function Page<T,>(p: T) { return <p>{1}</p> }\nconst small = a < b && c > d\nclass Last {}"
    assert tsx(text)[0] == ["export function Page<T,>(p: T) { ... }", "class Last { ... }"]


RS = [
    ("pub fn parse(input: &str) -> Result<Ast, Error> {\n    todo!()\n}\n", ["pub fn parse(input: &str) -> Result<Ast, Error> { ... }"], ["parse"]),
    ("pub struct Parser {\n    input: String,\n    pos: usize,\n}\npub struct Unit;\nstruct Pair(u8, [u8; 4]);", ["pub struct Parser { ... }", "pub struct Unit;", "struct Pair(u8, [u8; 4]);"], ["Parser", "Unit", "Pair"]),
    ("pub enum Status {\n    Idle,\n    Done { at: u8 },\n}", ["pub enum Status { ... }"], ["Status"]),
    ("pub trait Visitor {\n    fn visit(&self, node: &Node);\n    fn twice<'a>(&'a self) -> &'a str { \"}\" }\n}", ["pub trait Visitor { ... }", "fn visit(&self, node: &Node);", "fn twice<'a>(&'a self) -> &'a str { ... }"], ["Visitor", "visit", "twice"]),
    ("impl<'a, T: Into<Vec<u8>>> From<T> for Own<'a>\nwhere\n    T: Copy,\n{\n    fn from(x: T) -> Self { impl Inner {} '{' }\n}", ["impl<'a, T: Into<Vec<u8>>> From<T> for Own<'a>\nwhere\n    T: Copy, { ... }", "fn from(x: T) -> Self { ... }"], ["from"]),
    ("fn a() { let s = r#\"fn no() { \"quoted\" \"#; let c = '\\u{7b}'; let d = '\"'; 'out: loop { break 'out } }\nfn b() {}", ["fn a() { ... }", "fn b() { ... }"], ["a", "b"]),
    ("/* /* fn no() {} */ fn no2() {} */ // fn no3() {}\n#[derive(Debug)]\n#[cfg(feature = \"{\")]\npub(crate) async unsafe fn yes() {}", ["pub(crate) async unsafe fn yes() { ... }"], ["yes"]),
    ("macro_rules! m { ($x:ident) => { fn $x() {} } }\nlazy! { fn no() {} }\nextern \"C\" fn call(x: fn(u8) -> u8) -> impl Fn() { x }\nconst F: fn() = call;", ["extern \"C\" fn call(x: fn(u8) -> u8) -> impl Fn() { ... }"], ["call"]),
    ("type Map<K> = HashMap<K, Box<dyn Fn(u8) -> u8>>;\nmod tests { fn hidden() {} }\nfn last() {}", ["type Map<K> = HashMap<K, Box<dyn Fn(u8) -> u8>>;", "fn last() { ... }"], ["Map", "last", "tests"]),
]


@pytest.mark.parametrize(("text", "want", "exports"), RS)
def test_rust(text, want, exports):
    lines, _, found = parsers.rust_file(text)
    assert (lines, found) == (want, exports)


def test_rust_imports():
    text = "mod utils;\npub(super) mod parser;\nuse std::collections::HashMap;\nuse crate::types::Ast;\npub use super::{a, b::{c, d}};\nuse crate::x as y;\n"
    assert parsers.rust_file(text)[1] == ["mod:utils", "mod:parser", "crate::types::Ast", "super::{a, b::{c, d}}", "crate::x as y"]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_text_is_parsed(seed):
    """Tokens cover the text in order, and no text fails or hangs."""
    rng = random.Random(seed)
    pieces = ["function f", "(", ")", "{", "}", "<", ">", "`", "${", "'", '"', "/", "/*", "*/", "//", "\n", " ", "=", "type A", "class B", "import ", "export ", ";", ":", "@x", "<b>", "r#\"", "'a", "#", "\\", "é", "=>"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        for made in (tokens.script(text), tokens.script(text, True), tokens.rust(text)):
            assert all(a.end <= b.start for a, b in zip(made, made[1:], strict=False))
        for parse in (ts, tsx, parsers.rust_file):
            parse(text)
