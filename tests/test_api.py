"""The interface from files to contexts."""

from lodeseek.engine import Engine
from lodeseek.sources.skills import front_matter, read_skills

FILES = {
    "src/parser.py": 'import os\n\ndef parse_text(text):\n    """Parses text into records."""\n    return clean(text)\n\n\ndef clean(text):\n    return text.strip()\n',
    "src/app.js": "function render(page) {\n  return draw(page);\n}\n",
    "docs/guide.md": "Welcome to the records guide.",
    "web/index.html": "<html><h1>Home</h1></html>",
    "web/x.css": ".a{color:#fff}",
    "web/i.png": "png",
    "src/broken.py": "def (",
}


def test_engine(spark, tmp_path):
    for p, t in FILES.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    e = Engine(spark, str(tmp_path / "home"))
    n = e.index(str(tmp_path / "repo"), "one")
    assert n == e.index(str(tmp_path / "repo"), "one") and e.repos() == ["one"]  # a second time replaces
    assert {(r.key, r.n) for r in e.stats("one").where("grouping = 'type'").collect()} >= {("function", 3), ("document", 3), ("image", 1)}
    assert e.search("parses text into records", "one", 3).first().name == "parse_text"
    text = e.context("explain how parse_text works in parser", "one")
    assert text.startswith("ARCHIVOS: ") and "parse_text" in text
    assert "records guide" in e.context("hola guide", "one", "no_code")
    assert "clean" in e.retrieve("parses text", "one")
    assert "Analiza el diseño" in e.context("review the design", "one", "design_review")


def test_skills(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nname: tests\npriority: 5\ntask_types: [test_gen]\ntriggers:\n  - 'pytest'\n  - cover\nfile_extensions: [.py]\n---\nWrite tests.\n")
    (tmp_path / "b.md").write_text("No front matter.")
    got = read_skills(spark, str(tmp_path)).collect()
    assert [(r.name, r.priority, r.task_types, r.triggers, r.file_extensions) for r in got] == [("tests", 5, ["test_gen"], ["pytest", "cover"], ["py"]), ("b", 0, [], [], [])]
    assert front_matter(None) == ({}, "")
