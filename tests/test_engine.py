"""Sources, retrieval, graphs, rendering, state and streams."""

import random

from pyspark.sql import functions as F

from lodeseek.functions import tasks
from lodeseek.operators import evaluate, fusion, graph, lexical, render, service, sessions
from lodeseek.schema import CAPSULE
from lodeseek.sources import files


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string")


def test_tasks(spark):
    cases = {"crea una función nueva": "code_gen", "arregla el bug": "debug", "busca todas las clases": "search", "tests de cobertura": "test_gen", "hola": "no_code", "snake_case": "code_query", "refactoriza el módulo": "refactor", "auditoria de seguridad": "audit"}
    got = tasks.classify_task(ask(spark, *cases), "q").orderBy("i").collect()
    assert [r.task for r in got] == list(cases.values())
    row = spark.range(1).select(tasks.budget(F.lit("debug")), tasks.complexity(F.lit("explica esto")), tasks.framework_mention(F.lit("a login page")), tasks.framework_mention(F.lit("a login page"), False)).first()
    assert tuple(row) == (2500, "simple", "", "gin")


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "parse_json parse json text"), (2, "render html page"), (3, "json json")], "id int, text string")
    got = lexical.top(lexical.bm25(docs, "json", "id", "text"), 5, "score", "id").collect()
    assert [r.id for r in got] == [3, 1]
    assert lexical.bm25(docs, "unknown", "id", "text").count() == 0
    assert lexical.bm25(docs, "", "id", "text").count() == 0
    assert lexical.bm25(docs.limit(0), "json", "id", "text").count() == 0
    twice = {r.id: r.score for r in lexical.bm25(docs, "json json", "id", "text").collect()}
    assert all(abs(twice[r.id] - 2 * r.score) < 1e-12 for r in got)


def test_bm25_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "parse_json parse json text"), (2, "render html page"), (3, "json json"), (4, None), (5, "")], "id int, text string")
    lexical.write_index(docs, "id", "text", str(tmp_path))
    for ask in ("json", "json json page", "unknown", "", "parse html TEXT"):
        want = {r.id: round(r.score, 12) for r in lexical.bm25(docs, ask, "id", "text").collect()}
        assert {r.id: round(r.score, 12) for r in lexical.search_index(spark, str(tmp_path), ask).collect()} == want
    plan = lexical.search_index(spark, str(tmp_path), "json page")._jdf.queryExecution().toString()
    assert "In(token, [json,page])" in plan
    lexical.write_index(docs.limit(0), "id", "text", str(tmp_path / "none"))
    assert lexical.search_index(spark, str(tmp_path / "none"), "json").count() == 0


def test_rrf_ignores_the_order_of_lists(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id int, rank int")
    one = {r.id: round(r.score, 12) for r in fusion.rrf([a, b]).collect()}
    assert one == {r.id: round(r.score, 12) for r in fusion.rrf([b, a]).collect()}
    assert max(one, key=one.get) == 2


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X"), ("a", "b", "X"), ("z", "q", "Y")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(x, x) for x in "abcdq"], "id string, name string")
    for depth, want in ((0, {"a": 0}), (1, {"a": 0, "b": 1}), (2, {"a": 0, "b": 1, "c": 2}), (5, {"a": 0, "b": 1, "c": 2})):
        got = graph.bfs(edges, spark.createDataFrame([("a",)], "seed string"), depth)
        assert {r.node: r.level for r in got.collect()} == want
    inside, used = graph.subgraph(nodes, edges, spark.createDataFrame([("z",)], "seed string"), 2)
    assert [r.id for r in inside.collect()] == ["q"] and used.count() == 1
    kept, e = graph.filter_by_relation(nodes, edges, spark.createDataFrame([("d",)], "seed string"), ["Y"])
    assert {r.id for r in kept.collect()} == {"d", "q"} and e.count() == 1


def capsules(spark, n=5, **over):
    rows = []
    for i in range(n):
        r = {"id": f"i{i}", "type": "function", "name": f"f{i}", "file_path": f"src/m{i % 2}.py", "start_line": i, "end_line": i + 2, "language": "python", "signature": f"def f{i}()", "content": f"body {i}", "docstring": None if i % 2 else f"Doc {i}.", "calls": [f"f{(i + 1) % n}"], "imports": [], "properties": [("lineas", "3")], "seq": 0, "error": None}
        rows.append(tuple((r | over)[f.name] for f in CAPSULE.fields))
    return spark.createDataFrame(rows, CAPSULE)


def test_render(spark):
    every = capsules(spark)
    top = every.withColumn("place", F.col("start_line") + 1)
    text = lambda df: df.first().context
    out = text(render.compress(top, every, 500, "code_query"))
    assert out.startswith("ARCHIVOS: src/m0.py, src/m1.py\n\n[f0|function] src/m0.py\n```\nbody 0\n```") and "[f0]-[LLAMA]-[f1]" in out
    assert "[f1|function] signature=def f1()" in text(render.refactor(top, every)) and "f4" in text(render.refactor(top, every))
    found = text(render.search_map(top, every, 200))
    assert "RESUMEN: 2 funciones/clases SIN docstring, 3 CON docstring." in found and found.endswith("Total: 5 capsulas en 2 archivos")
    assert "src/ (5 archivos)" in text(render.onboard(every))
    empty = top.limit(0)
    assert text(render.query(empty, 100)) == "" and text(render.code_edit(empty)) == "" and text(render.audit(empty)) == ""
    assert text(render.compress(top, every, 1, "code_query")).count("|function]") == 0


def test_search_map_folds_like_a_loop(spark):
    every = capsules(spark, 40)
    top = every.where("start_line < 3").withColumn("place", F.col("start_line") + 1)
    for budget in (100, 200, 300, 1000):
        out = render.search_map(top, every, budget).first().context
        head = out.split("\nMapa completo por archivo:")[0].replace("\n", "")
        room = max(budget * 4 - len(head) - len("Mapa completo por archivo:"), int(budget * 4 * 0.4))
        lines, used = [], 0
        for f in ("src/m0.py", "src/m1.py"):
            if used + len(f) + 2 > room:
                break
            lines.append(f"\n{f}:")
            used += len(f) + 2
            for r in every.where(F.col("file_path") == f).orderBy("start_line").limit(10).collect():
                line = f"  [function] {r.name} {'✓' if r.docstring else '✗'}doc"
                if used + len(line) > room:
                    break
                lines.append(line)
                used += len(line)
        assert out.split("Mapa completo por archivo:\n")[1] == "\n".join([*lines, "\nTotal: 40 capsulas en 2 archivos"])


def test_evaluate(spark):
    row = spark.range(1).select(evaluate.criteria_score(F.lit("El Módulo Über"), F.array(F.lit("modulo"), F.lit("UBER"), F.lit("x"))), evaluate.criteria_score(F.lit("x"), F.array().cast("array<string>"))).first()
    assert tuple(row) == (0.67, 0.0)
    assert abs(sum(evaluate.MARKS.values()) - 1) < 1e-12


def test_rate_limit_and_breaker(spark):
    rng = random.Random(1)
    ev = sorted((rng.randrange(2), i, rng.uniform(0, 60), rng.random() < 0.5) for i in range(400))
    df = spark.createDataFrame(ev, "u int, i int, t double, ok boolean")
    got = {r.i: r.admitted for r in service.rate_limit(df, "u", "t", "i", 5, 4.0).collect()}
    state = {r.i: r.state for r in service.circuit_breaker(df, "u", "t", "i", "ok").collect()}
    for u in (0, 1):
        held, bad, last = [], 0, 0.0
        for _, i, t, ok in sorted((e for e in ev if e[0] == u), key=lambda e: (e[2], e[1])):
            held = [x for x in held if t - x < 4.0]
            assert got[i] == (len(held) < 5)
            held += [t] if len(held) < 5 else []
            if bad >= 3 and t - last <= 30:
                assert state[i] == "open"
                continue
            bad = 0 if bad >= 3 else bad
            assert state[i] == ("ok" if ok else "failed")
            bad, last = (0, last) if ok else (bad + 1, t)


def test_retention(spark):
    for n in (50, 100, 101, 151, 152, 400):
        df, buf = spark.range(n), []
        for i in range(n):
            buf.append(i)
            if len(buf) > 100:
                buf = buf[-50:]
        assert sorted(r.id for r in service.retained(df, ["id"], 100, 50).collect()) == buf


def test_sessions(spark):
    m = spark.createDataFrame([(1, i, "user", f"mira en src/a{i}.py la función f{i}") for i in range(12)] + [(2, 0, "user", None)], "s int, t int, role string, text string")
    got = sessions.compact(m, "s", "t", "text", 5).orderBy("s", "place").collect()
    assert len(got) == 5 and got[0].role == "system" and "f0, f1" in got[0].content and got[1].place == 10
    assert sessions.compact(m, "s", "t", "text", 12).count() == 13
    assert sessions.compact_loop(m, "s", "t", "text").where("s = 1").count() == 9
    a, b = sessions.delete(m.select("s").distinct(), m, spark.createDataFrame([(1,)], "s int"), "s")
    assert a.count() == 1 and b.count() == 1


def test_files(spark, tmp_path):
    for p, t in (("src/a.py", "x = 1"), ("node_modules/b.py", "y"), ("notes.txt", "no"), ("docs/n.txt", "yes"), ("i.png", "\x89")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = files.read_sources(spark, str(tmp_path)).collect()
    assert {(r.file_path.split(tmp_path.name + "/")[1], r.language) for r in got} == {("src/a.py", "python"), ("docs/n.txt", "text"), ("i.png", "image")}
    assert files.read_sources(spark, str(tmp_path), ["python"]).count() == 1
    caps = capsules(spark)
    files.save_index(caps, str(tmp_path / "index"))
    assert sorted(map(tuple, files.load_index(spark, str(tmp_path / "index")).collect())) == sorted(map(tuple, caps.collect()))


def test_images(spark):
    from lodeseek.operators.extract_markup import image_capsules

    r = image_capsules(spark.createDataFrame([("a/logo.svg", bytearray(b"abc"))], "file_path string, data binary")).first()
    assert r.content == "data:image/svg+xml;base64,YWJj" and [tuple(p) for p in r.properties] == [("mime", "image/svg+xml"), ("size_bytes", "3")]


def test_sql_functions(spark):
    from lodeseek.functions.registry import Hooks, register

    register(spark)
    got = spark.sql("SELECT token_budget('search') AS b, d.* FROM (SELECT 'def f():\\n  pass' AS s) t, LATERAL python_defs(t.s) d").collect()
    assert [tuple(r) for r in got] == [(500, "function", "f", 1, 2)]
    h = Hooks()
    h.texts += [str.upper, lambda t: t + "!"]
    h.checks.append(lambda tool, args: tool != "rm")
    assert h.response("a") == "A!" and h.allowed("ls", {}) and not h.allowed("rm", {})


def test_streams(spark, tmp_path, data):
    from lodeseek.operators.extract_python import python_capsules
    from lodeseek.streaming import incremental as I

    src = tmp_path / "ev"
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    ev = spark.readStream.schema(schema).parquet(str(src))
    q = I.tumbling(ev, ["event_type"], "1 day").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = I.tumbling(spark.read.parquet(str(src)), ["event_type"], "1 day")
    assert sorted((r.start, r.event_type, r.n) for r in spark.table("w").collect()) == sorted((r.start, r.event_type, r.n) for r in batch.collect())

    as_calls = lambda e: e.select("event_id", (F.col("user_id") % 5).alias("u"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    q = I.admit_stream(as_calls(ev), "u", "s", "event_id", 3, 3600.0).writeStream.format("memory").queryName("a").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = service.rate_limit(as_calls(spark.read.parquet(str(src))), "u", "s", "event_id", 3, 3600.0)
    assert {(r.event_id, r.admitted) for r in spark.table("a").collect()} == {(r.event_id, r.admitted) for r in want.collect()}

    inbox, index = tmp_path / "in", str(tmp_path / "index")
    put = lambda n, text: spark.createDataFrame([("a.py", text)], "file_path string, content string").write.mode("append").json(str(inbox))
    put(0, "def one():\n    pass\n")
    for text in ("def one():\n    pass\n", "def two():\n    pass\n"):
        if text.startswith("def two"):
            put(1, text)
        stream = spark.readStream.schema("file_path string, content string").json(str(inbox))
        I.reindex(stream, python_capsules, index, str(tmp_path / "cp")).awaitTermination()
    assert [r.name for r in spark.read.parquet(f"{index}/version=1").collect()] == ["two"]
