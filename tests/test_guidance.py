"""Guidance files of folders, by model before provider before default."""

from skeinwork.operators import guidance


def test_order_precedence_and_what_is_there_already(spark):
    files = [("/home", "x.md", "h"), ("/", "x.md", "r"), ("/", "AGENTS.md", "core"), ("/a", "x.md", "core2"), ("/a", "AGENTS.md", "core2"), ("/a/b", "x.md", "ab"), ("/a/b", "y.md", "y"), ("/a/b", "z.md", "z"), ("/a/bc", "x.md", "no"), ("/a/b", "s.md", "stand-in")]
    asked = [(1, "/a/b", "p", "model-7"), (2, "/a/b/", "p", None), (3, "/a/b", "q", ""), (4, "/", "nobody", "other"), (5, "/a/b", "r", "MODEL-8"), (6, "/a/b", "s", None)]
    out = guidance.guidance_files(spark.createDataFrame(asked, "id long, cwd string, provider string, model string"), spark.createDataFrame(files, "folder string, name string, content string"), "/home", [("model-7", ["y.md", "x.md"]), ("model*", ["z.md", "AGENTS.md"])], {"p": ["x.md"]}, {"p": ["z.md"], "q": ["z.md"], "s": ["s.md"]}, "s.md")
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.folder, r.content))
    x = [("/home", "h"), ("/", "r")]
    # /a's x.md says what its core file says; s.md stands in for a core file that /a/b lacks
    assert got == {1: [*x, ("/a/b", "y"), ("/a/b", "ab")], 2: [*x, ("/a/b", "ab")], 3: [("/a/b", "z")], 5: [("/a/b", "z")]}
