"""Registering functions for SQL, and hooks around a request."""

from collections.abc import Callable
from functools import reduce

import ast as _ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.udtf import UserDefinedTableFunction
from pyspark.sql.functions import udtf

from lodeseek.functions import tasks


def python_definitions() -> UserDefinedTableFunction:
    """Table function python_defs(source): top-level functions and classes with their lines."""

    @udtf(returnType="kind string, name string, start_line int, end_line int")
    class PythonDefinitions:
        def eval(self, source: str):
            try:
                tree = _ast.parse(source or "")
            except (SyntaxError, ValueError):
                return
            for n in tree.body:
                if isinstance(n, _ast.FunctionDef | _ast.AsyncFunctionDef | _ast.ClassDef):
                    yield ("class" if isinstance(n, _ast.ClassDef) else "function", n.name, n.lineno, n.end_lineno)

    return PythonDefinitions


def register(spark: SparkSession) -> None:
    """Make the engine's functions available to SQL."""
    spark.udtf.register("python_defs", python_definitions())
    marks = ", ".join(f"'{k}', {v}" for k, v in tasks.TOKEN_BUDGET.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_budget(task STRING) RETURNS INT RETURN try_element_at(map({marks}), task)")


class Plugin:
    """What a plugin may do around a request; each hook does nothing unless overridden."""

    name, version = "base", "0.1.0"

    def on_init(self, config: dict, repo: str) -> list:
        return []

    def on_tool_register(self, registry) -> None:
        return None

    def on_pre_context(self, query: str, capsules) -> str:
        return ""

    def on_post_response(self, response: str, query: str) -> str:
        return response

    def on_pre_tool(self, tool: str, args: dict) -> bool:
        return True

    def on_post_tool(self, tool: str, args: dict, result: str) -> str:
        return result

    def on_pre_llm(self, messages: list[dict]) -> list[dict]:
        return messages

    def on_post_llm(self, response: str) -> str:
        return response

    def on_shutdown(self) -> None:
        return None

    def execute(self, tool: str, args: dict, repo: str) -> str:
        return f"[{self.name}: tool '{tool}' not found]"


class PluginChain:
    """Plugins in order. A plugin that fails is passed over and does not stop the others."""

    def __init__(self, *plugins: Plugin):
        self.plugins = list(plugins)

    def _said(self, call: Callable[[Plugin], object]) -> list:
        out = []
        for p in self.plugins:
            try:
                out.append(call(p))
            except Exception:  # noqa: BLE001, S112 - plugins are foreign code
                continue
        return out

    def _folded(self, value, *steps: Callable):
        for p in self.plugins:
            try:
                for step in steps:
                    value = step(p, value)
            except Exception:  # noqa: BLE001, S112 - plugins are foreign code
                continue
        return value

    def init(self, config: dict, repo: str, registry=None) -> list:
        """Tools of all plugins."""
        tools = [t for got in self._said(lambda p: p.on_init(config.get(p.name, {}), repo)) for t in got or []]
        self._said(lambda p: p.on_tool_register(registry))
        return tools

    def pre_context(self, query: str, capsules) -> str:
        return "\n".join(filter(None, self._said(lambda p: p.on_pre_context(query, capsules))))

    def post_response(self, response: str, query: str) -> str:
        return self._folded(response, lambda p, r: p.on_post_response(r, query), lambda p, r: p.on_post_llm(r))

    def pre_tool(self, tool: str, args: dict) -> bool:
        return all(self._said(lambda p: p.on_pre_tool(tool, args)))

    def post_tool(self, tool: str, args: dict, result: str) -> str:
        return self._folded(result, lambda p, r: p.on_post_tool(tool, args, r))

    def pre_llm(self, messages: list[dict]) -> list[dict]:
        return self._folded(messages, lambda p, m: p.on_pre_llm(m))

    def shutdown(self) -> None:
        self._said(lambda p: p.on_shutdown())

    def info(self) -> list[tuple[str, str, str, bool]]:
        """(name, type, version, running) of each."""
        return [(p.name, "builtin", p.version, True) for p in self.plugins]


class Hooks:
    """Functions around a request, in order of registration: frames are transformed, texts folded, calls allowed only by all."""

    def __init__(self) -> None:
        self.frames: list[Callable[[DataFrame], DataFrame]] = []
        self.texts: list[Callable[[str], str]] = []
        self.checks: list[Callable[[str, dict], bool]] = []

    def context(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, f: d.transform(f), self.frames, df)

    def response(self, text: str) -> str:
        return reduce(lambda t, f: f(t), self.texts, text)

    def allowed(self, tool: str, args: dict) -> bool:
        return all(f(tool, args) for f in self.checks)
