"""Where callers plug in: channels, filters, models and hooks.

A channel is ``search(query: DataFrame, top_k: int) -> DataFrame`` of (query_id,
fact_id, score); a filter takes and gives such a table.  Models are columns to
columns, so that plans stay lazy and the engine decides where they run.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


@runtime_checkable
class Channel(Protocol):
    def search(self, queries: DataFrame, top_k: int) -> DataFrame: ...


@runtime_checkable
class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


@runtime_checkable
class Generator(Protocol):
    def generate(self, prompt: Column) -> Column: ...


@runtime_checkable
class CrossEncoder(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class Channels:
    """Named channels and the filters that rewrite what they find."""

    def __init__(self) -> None:
        self.channels: dict[str, Channel] = {}
        self.filters: list[Callable[[DataFrame], DataFrame]] = []

    def register(self, name: str, channel: Channel) -> None:
        if not isinstance(channel, Channel):
            raise TypeError(f"{name} has no search(queries, top_k)")
        self.channels[name] = channel

    def register_filter(self, change: Callable[[DataFrame], DataFrame]) -> None:
        self.filters.append(change)

    def run(self, queries: DataFrame, top_k: int, only: set[str] | None = None) -> DataFrame | None:
        """(channel, query_id, fact_id, score) of all channels; one whose plan cannot be
        made is left out and logged, None if none is left."""
        found = None
        for name, channel in self.channels.items():
            if only is not None and name not in only:
                continue
            try:
                part = channel.search(queries, top_k).select(F.lit(name).alias("channel"), "query_id", "fact_id", "score")
            except Exception:
                log.exception("channel %s failed", name)
                continue
            found = part if found is None else found.unionByName(part)
        for change in self.filters:
            found = change(found) if found is not None else None
        return found


class Hooks:
    """Steps before an operation, which may veto it by raising, and after it, which may not."""

    def __init__(self) -> None:
        self.before: dict[str, list[Callable]] = {}
        self.after: dict[str, list[Callable]] = {}
        self.listeners: list[Callable[[str, object], None]] = []

    def pre(self, operation: str, step: Callable) -> None:
        self.before.setdefault(operation, []).append(step)

    def post(self, operation: str, step: Callable) -> None:
        self.after.setdefault(operation, []).append(step)

    def listen(self, step: Callable[[str, object], None]) -> None:
        self.listeners.append(step)

    def run(self, operation: str, work: Callable, *args):
        for step in self.before.get(operation, []):
            step(*args)
        done = work(*args)
        for step in [*self.after.get(operation, []), *(lambda x, s=s: s(operation, x) for s in self.listeners)]:
            try:
                step(done)
            except Exception:
                log.exception("a step after %s failed", operation)
        return done
