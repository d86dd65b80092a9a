"""Extraction: what the syntax tree and the patterns must find."""

from lodeseek.operators.extract_generic import block_end, calls_in, signature
from lodeseek.operators.extract_generic import extract as generic
from lodeseek.operators.extract_python import extract
from lodeseek.schema import prop


def one(text, kind=None, path="pkg/mod.py"):
    got = [c for c in extract(path, text) if c["type"] != "file_header" and (kind is None or c["type"] == kind)]
    assert len(got) == 1
    return got[0], {p["k"]: p["v"] for p in got[0]["properties"]}


def test_function():
    c, p = one('def add(a: int, b: int = 2) -> int:\n    """Adds."""\n    return max(a, b)\n')
    assert (c["type"], c["signature"], c["docstring"], c["calls"]) == ("function", "def add(a: int, b: int = 2) -> int", "Adds.", ["max"])
    assert p == {"parametros": "a: int, b: int = 2", "tipo_retorno": "int", "lineas": "3", "module": "mod"}


def test_short_function_without_docstring_shows_its_source():
    c, _ = one("def f():\n    return 1\n")
    assert c["docstring"] == "def f():\n    return 1"


def test_kinds():
    assert one("async def f():\n    pass\n")[0]["type"] == "async_function"
    assert one("def test_x():\n    pass\n")[0]["type"] == "test"
    assert one("import pytest\n\n@pytest.fixture\ndef f():\n    pass\n", "test")[0]["name"] == "f"
    c, p = one("@dataclass(frozen=True)\nclass A:\n    x: int = 1\n")
    assert c["type"] == "dataclass" and p["decorators"] == "dataclass(frozen=True)"
    assert one("class E(pkg.ValueError):\n    pass\n")[0]["type"] == "exception"
    c, p = one("class A(B, C):\n    def m(self):\n        return f()\n")
    assert (c["type"], c["calls"], p["metodos"], p["hereda_de"]) == ("class", ["f"], "m", "B, C")
    assert one("if __name__ == '__main__':\n    run()\n")[0]["name"] == "mod.__main__"
    assert [c["type"] for c in extract("a.py", "X = 1\ny = 2\n")] == ["file_header", "constant", "variable"]


def test_imports():
    got = [(c["type"], c["name"]) for c in extract("a.py", "import os, sys\nfrom m import thing, Kind\n") if c["type"] != "file_header"]
    assert got == [("module", "os"), ("module", "sys"), ("function", "m.thing"), ("class", "m.Kind")]


def test_bad_and_empty_files():
    assert extract("a.py", "") == [] and extract("a.py", "def (") == []


def test_generic_languages():
    js = generic("a.js", "// function no() {}\nfunction go(a, b) {\n  run(a);\n}\nclass A extends B {}\nimport x from 'y'\n", "javascript")
    assert [(c["type"], c["name"], c["start_line"], c["end_line"]) for c in js] == [("function", "go", 2, 4), ("class", "A", 5, 5), ("module", "y", 6, 7)]
    assert js[0]["calls"] == ["go", "run"] and js[0]["signature"] == "function go(a, b)"
    ruby = generic("a.rb", "def plain(x)\n  1\nend\ndef self.other\nend\n", "ruby")
    assert [c["name"] for c in ruby] == ["plain", "other"]
    sql = generic("a.sql", "CREATE TABLE t (a int);\nCREATE OR REPLACE VIEW v AS SELECT 1;\n", "sql")
    assert [(c["name"], c["type"]) for c in sql] == [("t", "function"), ("v", "function")]
    assert [c["name"] for c in generic("a.go", "func (s *S) Get(k string) int {\n}\n", "go")][0] == "Get"
    assert generic("m.zig", "pub fn main() void {\n", "zig")[0]["name"] == "__m_L1"
    assert calls_in("EXEC one; CALL two(1)", "sql") == ["one", "two"]
    assert signature("rust", "function", "f", "x" * 200) == f"fn f({'x' * 117}...)"
    assert block_end(["a {", "{", "}", "}"], 1, "go") == 4 and block_end(["x"] * 50, 1, "go") == 21


def test_fault_isolation(spark):
    from lodeseek.operators.extract_python import python_capsules

    files = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "def ("), ("c.py", None), ("d.py", "\0")], "file_path string, content string")
    assert [(r.file_path, r.name) for r in python_capsules(files).collect()] == [("a.py", "f")]


def test_frameworks(spark):
    from lodeseek.operators.extract_python import python_capsules
    from lodeseek.operators.frameworks import detect_frameworks

    text = "@app.get('/x')\ndef h():\n    pass\n\nclass M(BaseModel):\n    pass\n\ndef my_middleware(r):\n    return r\n\n@app.route('/y')\ndef g():\n    pass\n"
    got = detect_frameworks(python_capsules(spark.createDataFrame([("a.py", text)], "file_path string, content string")))
    assert {(r.name, r.type, r.framework) for r in got.collect()} == {("h", "endpoint", "fastapi"), ("M", "model", "pydantic"), ("my_middleware", "middleware", "fastapi"), ("g", "endpoint", "flask")}
    assert got.select(prop("module").alias("m")).distinct().count() == 1
