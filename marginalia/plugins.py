"""Tools, extensions and tasks by name, and what is done when one fails."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any


@dataclass
class Plugin:
    name: str
    call: Callable[..., Any]
    category: str = "tool"
    needs: tuple[str, ...] = ()
    schedule: str | None = None


@dataclass
class Registry:
    """Plugins by name; extensions start after those they need."""

    plugins: dict[str, Plugin] = field(default_factory=dict)

    def add(self, name: str, category: str = "tool", needs: tuple[str, ...] = (), schedule: str | None = None) -> Callable:
        """Registers a function: a tool, an extension with what it needs, or a task with a schedule."""

        def put(f: Callable[..., Any]) -> Callable[..., Any]:
            if name in self.plugins:
                raise ValueError(f"{name} is registered already")
            self.plugins[name] = Plugin(name, f, category, needs, schedule)
            return f

        return put

    def names(self, category: str | None = None) -> list[str]:
        return sorted(p.name for p in self.plugins.values() if category in (None, p.category))

    def call(self, name: str, *args: Any, **options: Any) -> Any:
        if name not in self.plugins:
            raise LookupError(f"there is no plugin {name}")
        return self.plugins[name].call(*args, **options)

    def start_order(self) -> list[str]:
        """Names with everything that is needed before what needs it; unknown needs and circles are errors."""
        lost = {n for p in self.plugins.values() for n in p.needs} - set(self.plugins)
        if lost:
            raise LookupError(f"needed and not registered: {', '.join(sorted(lost))}")
        try:
            return list(TopologicalSorter({p.name: sorted(p.needs) for p in sorted(self.plugins.values(), key=lambda p: p.name)}).static_order())
        except CycleError as e:
            raise ValueError(f"circular needs: {' > '.join(e.args[1])}") from e


def with_fallback(value: Any = None, seen: list[dict] | None = None, component: str = "") -> Callable:
    """A function that returns a value in place of an error, which is put down in `seen`; without a value the error goes on."""

    def wrap(f: Callable[..., Any]) -> Callable[..., Any]:
        @functools.wraps(f)
        def run(*args: Any, **options: Any) -> Any:
            try:
                return f(*args, **options)
            except Exception as e:
                if seen is not None:
                    seen.append({"component": component or f.__name__, "ok": False, "fallback": value is not None, "message": str(e)})
                if value is None:
                    raise
                return value

        return run

    return wrap


def timed(samples: list[tuple[str, float, bool]], name: str = "", clock: Callable[[], float] = time.perf_counter) -> Callable:
    """Adds (name, seconds, failed) of every call to `samples`, which events.metrics sums up as a table."""

    def wrap(f: Callable[..., Any]) -> Callable[..., Any]:
        @functools.wraps(f)
        def run(*args: Any, **options: Any) -> Any:
            start, failed = clock(), True
            try:
                out = f(*args, **options)
                failed = False
                return out
            finally:
                samples.append((name or f.__name__, clock() - start, failed))

        return run

    return wrap
