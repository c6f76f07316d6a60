"""Settings, state, context files, guidance and sources."""

import pytest

from skeinwork.sources import config as c


def test_jsonc_and_where_it_breaks():
    text = '{\n  // a note\n  "a": "//no, note,]", /* b */ "b": [1, 2,],\n}'
    assert c.parse_jsonc(text) == {"a": "//no, note,]", "b": [1, 2]}
    with pytest.raises(ValueError, match="x:3:"):
        c.parse_jsonc('{\n // y\n "a" 1}', "x")


def test_layers(tmp_path):
    (tmp_path / "global.json").write_text('{"a": {"x": 2}, "l": [1]}')
    (tmp_path / "own.json").write_text('{"a": {"y": 3}, "l": [2], "z": null} // end')
    paths = [str(tmp_path / n) for n in ("global.json", "none.json", "own.json")]
    defaults = {"a": {"x": 1, "y": 1}, "l": [], "z": 5}
    assert c.load_config(defaults, paths, {"a": {"y": 4}}) == {"a": {"x": 2, "y": 4}, "l": [2], "z": 5}
    assert defaults["a"] == {"x": 1, "y": 1}

    def refuse(value):
        raise ValueError(value)

    with pytest.raises(ValueError):
        c.load_config(defaults, valid=refuse)
    (tmp_path / "global.json").write_text("[]")
    with pytest.raises(ValueError, match="not an object"):
        c.load_config(defaults, paths)


def test_state(tmp_path):
    s = c.State(str(tmp_path / "state"))
    assert s.read("a") is None
    s.write("a", {"n": 1})
    assert s.read("a") == {"n": 1}
    (tmp_path / "state" / "a.json").write_text("{")
    assert s.read("a") is None
    s.remove("a"), s.remove("a")


def test_context_files_and_guidance(tmp_path):
    (tmp_path / "AGENTS.md").write_text("top")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "AGENTS.md").write_text("below")
    assert [t for _, t in c.context_files(str(tmp_path / "d"), ["AGENTS.md"])] == ["top", "below"]
    ask = lambda model, provider, **kw: c.guidance(model, provider, {"gpt-*": "g"}, {"p": "q"}, "d", **kw)
    assert (ask("GPT-4", "p"), ask("x", "p"), ask("x", "r")) == ("g", "q", "d")
    assert ask("x", "r", present=[("AGENTS.md", " d ")]) is None


def test_sources_and_memo():
    s = c.Sources()
    s.register("b", 2, print), s.register("a", 1, print), s.register("b", 0, print)
    assert list(s) == ["b", "a"] and s.unregister("a") and not s.unregister("a")
    s.clear()
    assert list(s) == []
    m, made = c.Memo(), []
    make = lambda: made.append(1) or len(made)
    assert m.get("k", make) == m.get("k", make) == 1 and m.has("k")
    m.clear()
    assert not m.has("k") and m.get("k", make) == 2
