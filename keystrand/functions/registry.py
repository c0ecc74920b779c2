"""Predicates and aggregates by name.

A predicate is a function (key, record) -> boolean Column, an aggregate a function
(rows) -> DataFrame; both stay inside Catalyst.  ``name@module`` imports a module
and asks its ``plugin_descriptor(name)``.  Names are case-insensitive.  A plugin may say
which columns it ``needs`` ("key", "record"), and take the types and flags of the
select (a ``PluginContext``) as one argument more.
"""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from keystrand.errors import PluginExists, PluginNotFound
from keystrand.types import Kind

Predicate = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class PluginContext:
    """What a select tells its plugins: the types of keys and records, whether keys repeat, the column named and DISTINCT."""

    key_kind: Kind
    record_kind: Kind
    duplicates: bool
    on: str
    distinct: bool


@dataclass(frozen=True)
class Plugin:
    name: str
    predicate: Predicate | None = None
    aggregate: Callable[[DataFrame], DataFrame] | None = None
    needs: frozenset[str] = frozenset({"key", "record"})


def told(fn: Callable, takes: int, context: PluginContext) -> Callable:
    """The function with the context as its last argument, if it has room for one."""
    if len(inspect.signature(fn).parameters) <= takes:
        return fn
    return lambda *given: fn(*given, context)


class Registry:
    def __init__(self):
        self._plugins: dict[str, Plugin] = {}

    def add(self, plugin: Plugin) -> None:
        name = plugin.name.lower()
        if plugin.predicate is None and plugin.aggregate is None:
            raise PluginNotFound(f"{name} is neither a predicate nor an aggregate")
        if name in self._plugins:
            raise PluginExists(name)
        self._plugins[name] = plugin

    def predicate(self, name: str, fn: Predicate, needs: tuple[str, ...] = ("key", "record")) -> None:
        self.add(Plugin(name, predicate=fn, needs=frozenset(needs)))

    def aggregate(self, name: str, fn: Callable[[DataFrame], DataFrame], needs: tuple[str, ...] = ("key", "record")) -> None:
        self.add(Plugin(name, aggregate=fn, needs=frozenset(needs)))

    def get(self, name: str) -> Plugin:
        key = name.lower()
        if key not in self._plugins and "@" in name:
            short, module = name.split("@", 1)
            found = importlib.import_module(module).plugin_descriptor(short)
            if found is None:
                raise PluginNotFound(name)
            self._plugins[key] = found
        if key not in self._plugins:
            raise PluginNotFound(name)
        return self._plugins[key]
