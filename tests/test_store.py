"""Stored sessions and results, plugin hooks, events of a run, the benchmark driver, and indexing in the background."""

import json

from pyspark.sql import functions as F

from lodeseek.engine import Engine
from lodeseek.functions.registry import Plugin, PluginChain
from lodeseek.operators import evaluate, service, store
from lodeseek.streaming import events as EV


def test_sessions_are_kept(spark, tmp_path):
    own = store.SessionStore(spark, str(tmp_path))
    a, b = own.create("/repo", "openai/gpt-4o"), own.create("/other")
    assert len(a) == 16 and a != b
    for i in range(4):
        own.add(a, "user" if i % 2 == 0 else "assistant", f"text {i}", [{"name": "grep"}] if i == 3 else None, tokens=10 * i)
    row = store.SessionStore(spark, str(tmp_path)).get(a).first()
    assert (row.repo, row.model, row.message_count, row.total_tokens) == ("/repo", "openai/gpt-4o", 4, 60) and row.updated_at > row.created_at
    assert (own.get(b).first().message_count, own.get("none").count()) == (0, 0)
    assert [r.session for r in own.list().collect()] == [a, b]
    said = own.history(a, 2).collect()
    assert [r.content for r in said] == ["text 2", "text 3"] and said[0].tool_calls is None and json.loads(said[1].tool_calls) == [{"name": "grep"}]
    cost = service.session_costs(own.get(a), service.models(spark)).first()
    assert abs(cost.cost - (30 * 2.5 + 30 * 10) / 1e6) < 1e-12 and cost.saved == 4 * 20000 - 60
    own.add_all(spark.createDataFrame([(b, "user", "x", "[]", 3, 1.0, 1)], store.MESSAGES))
    own.delete(a)
    assert [r.session for r in own.list().collect()] == [b] and own.history(a).count() == 0 and own.get(b).first().total_tokens == 3


def test_results_expire_and_are_cleared(spark, tmp_path):
    cache = store.ResultCache(spark, str(tmp_path))
    rows = spark.createDataFrame([("Find it", "1"), ("other", "2")], "q string, v string")
    for kind in store.LIFETIMES:
        cache.put(kind, rows, "q", "v", now=100.0)
    assert cache.get("query", "  FIND IT ", now=159.0) == "1" and cache.get("query", "find it", now=160.0) is None
    assert cache.get("subgraph", "Find it", now=399.0) == "1" and cache.get("subgraph", "find it", now=101.0) is None
    assert cache.get("ontology", "other", now=1e12) == "2"
    cache.put("query", spark.createDataFrame([("find it", "3")], "q string, v string"), "q", "v", now=150.0)
    assert cache.get("query", "find it", now=200.0) == "3"
    cache.clear("subgraph:*", now=151.0)
    assert cache.get("subgraph", "other", now=152.0) is None and cache.get("ontology", "other", now=152.0) == "2"
    cache.clear(now=153.0)
    assert cache.get("ontology", "other", now=154.0) is None and cache.get("query", "none", now=1.0) is None


def test_plugins(spark):
    class Loud(Plugin):
        name = "loud"

        def on_init(self, config, repo):
            return [config["tool"], repo]

        def on_pre_context(self, query, capsules):
            return query.upper()

        def on_post_response(self, response, query):
            return response + query

        def on_post_llm(self, response):
            return response + "!"

        def on_pre_tool(self, tool, args):
            return tool != "rm"

    class Broken(Plugin):
        def on_init(self, config, repo):
            raise RuntimeError

        def on_pre_context(self, query, capsules):
            raise RuntimeError

        def on_post_response(self, response, query):
            return response + "b"

        def on_post_llm(self, response):
            raise RuntimeError

        def on_pre_tool(self, tool, args):
            raise RuntimeError

    chain = PluginChain(Loud(), Broken(), Plugin())
    assert chain.init({"loud": {"tool": "t"}}, "/r") == ["t", "/r"]
    assert chain.pre_context("q", []) == "Q" and PluginChain().pre_context("q", []) == ""
    assert chain.post_response("a", "q") == "aq!b"
    assert chain.pre_tool("ls", {}) and not chain.pre_tool("rm", {}) and chain.post_tool("ls", {}, "out") == "out" and chain.pre_llm([{"a": 1}]) == [{"a": 1}]
    assert chain.info()[0] == ("loud", "builtin", "0.1.0", True) and Plugin().execute("x", {}, "") == "[base: tool 'x' not found]"
    chain.shutdown()


def test_run_events(spark, tmp_path):
    run = [
        {"type": "context", "task_type": "debug", "tokens": 7}, {"type": "plugins", "plugins": [{"name": "p", "type": "builtin", "running": True, "tool_count": 0}]},
        {"type": "token", "text": "añ"}, {"type": "tool_start", "name": "grep", "args": {"pattern": "x", "n": 3}}, {"type": "tool_result", "name": "grep", "output": "y"},
        {"type": "unknown"}, {"type": "done", "respuesta": "r", "iterations": 1, "total_tokens": 9, "duration_ms": 4},
    ]
    lines = spark.createDataFrame([(1, json.dumps(e)) for e in run] + [(1, "no json"), (1, None)], "run int, line string")
    got = EV.parsed(lines, "line", EV.AGENT_EVENTS)
    assert tuple(EV.run_totals(got, "run").first()) == (1, 6, 1, 2, 9, True)
    assert tuple(EV.of_type(got, "tool_start", EV.AGENT_EVENTS, "run").first()) == (1, "grep", {"pattern": "x", "n": "3"})
    goal = spark.createDataFrame([('{"type": "plan", "steps": ["a", "b"]}',), ('{"type": "step_done", "step": 0, "status": "done", "progress": "1/2", "tokens": 5, "duration_ms": 6}',)], "line string")
    steps = EV.parsed(goal, "line", EV.GOAL_EVENTS)
    assert EV.of_type(steps, "plan", EV.GOAL_EVENTS).first().steps == ["a", "b"] and EV.of_type(steps, "step_done", EV.GOAL_EVENTS).first().tokens == 5
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = EV.parsed(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), "line", EV.AGENT_EVENTS)
    q = stream.writeStream.format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("runs").count() == 6


def test_benchmark_queries(spark):
    asked = spark.createDataFrame([(1, ["módulo", "x"]), (2, [])], "i int, criteria array<string>")
    got = evaluate.benchmark_queries(asked, lambda d: d.withColumn("answer", F.lit("El Modulo"))).orderBy("i").collect()
    assert [(r.criteria_score, r.criteria_hits, r.criteria_total, r.llm_correct) for r in got] == [(0.5, 1, 2, None), (0.0, 0, 0, None)]
    said = evaluate.benchmark_queries(asked, lambda d: d.withColumn("answer", F.lit(None).cast("string")), lambda d: d.withColumn("said", F.when(F.col("i") == 1, "La respuesta es sí").otherwise("No")))
    assert [(r.criteria_hits, r.llm_correct) for r in said.orderBy("i").collect()] == [(0, True), (0, False)]


def test_index_in_the_background(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def one():\n    return 1\n")
    engine = Engine(spark, str(tmp_path / "home"))
    assert engine.index_later(str(tmp_path / "src"), "r").result(timeout=120) == engine.capsules("r").count() > 0
