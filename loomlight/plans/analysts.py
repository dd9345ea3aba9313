"""Custom analysts: functions of a spans DataFrame that give findings, by name, beside or instead of the built-in ones."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Analyst = Callable[[DataFrame], DataFrame]


class Registry:
    """Analysts by name. With any registered, run() leaves the built-in ones out unless asked."""

    def __init__(self, built_in: dict[str, Analyst] | None = None) -> None:
        self.built_in, self.own = dict(built_in or {}), {}

    def register(self, name: str, analyst: Analyst) -> None:
        if name in self.own:
            raise ValueError(f"{name!r} is registered")
        self.own[name] = analyst

    def chosen(self, with_built_in: bool = False) -> dict[str, Analyst]:
        return {**(self.built_in if with_built_in or not self.own else {}), **self.own}

    def run(self, spans: DataFrame, with_built_in: bool = False) -> DataFrame:
        """All findings with the analyst's name; findings need trace_id, rule and severity."""
        parts = [f(spans).select("trace_id", "rule", "severity").withColumn("analyst", F.lit(name)) for name, f in self.chosen(with_built_in).items()]
        if not parts:
            raise ValueError("no analyst")
        return reduce(DataFrame.unionByName, parts)


def load_config(path: str) -> dict:
    """registry, analysts and readers that a Python file of configuration names."""
    spec = importlib.util.spec_from_file_location("loomlight_config", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return {k: getattr(module, k) for k in ("registry", "analysts", "adapters") if hasattr(module, k)}
