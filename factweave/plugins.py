"""Plugins: extra rules, return types and vetoes, by functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.keys import fold


def normal(name: str) -> str:
    """Registry names: ASCII lower case, no leading backslash."""
    return name.lstrip("\\").translate({i: i + 32 for i in range(65, 91)})


@dataclass
class Plugin:
    """``returns`` maps function names to a function from call rows (callee, types of arguments) to a column of types; ``rules``
    give issue rows from facts; ``veto`` is true for issues to drop; ``ready`` sees the facts once before rules run."""

    name: str
    returns: dict[str, Callable] = field(default_factory=dict)
    rules: list[Callable] = field(default_factory=list)
    veto: Callable | None = None
    ready: Callable | None = None


class Registry:
    def __init__(self, *plugins: Plugin):
        self.plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.add(p)

    def add(self, plugin: Plugin) -> None:
        if normal(plugin.name) in self.plugins:
            raise ValueError(f"{plugin.name} is registered already")
        self.plugins[normal(plugin.name)] = plugin

    def populated(self, facts) -> None:
        for p in self.plugins.values():
            if p.ready:
                p.ready(facts)

    def return_types(self, calls: DataFrame, callee: str = "callee") -> DataFrame:
        """``calls`` with ``returned``: what the first plugin that knows the callee says; null where none does."""
        out, value = calls, F.lit(None)
        for p in reversed(list(self.plugins.values())):
            for name, f in p.returns.items():
                value = F.when(fold(F.regexp_replace(callee, r"^\\", "")) == normal(name), f(F)).otherwise(value)
        return out.withColumn("returned", value)

    def issues(self, facts, found: DataFrame) -> DataFrame:
        """Found issues with those of the plugins' rules, without what a plugin vetoes."""
        for p in self.plugins.values():
            for rule in p.rules:
                found = found.unionByName(rule(facts), allowMissingColumns=True)
        for p in self.plugins.values():
            if p.veto:
                found = found.filter(~F.coalesce(p.veto(found), F.lit(False)))
        return found
