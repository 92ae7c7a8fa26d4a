"""Marks for functions that the analysis reads.  At run time every mark hands back the function it is given."""

from __future__ import annotations

from collections.abc import Callable


def _same[T: Callable](func: T) -> T:
    return func


def blocking[T: Callable](func: T) -> T:
    """Its callers wait: the function blocks the thread that runs it."""
    return _same(func)


def non_blocking[T: Callable](func: T) -> T:
    """Not to be reported, whatever the function calls."""
    return _same(func)


def unblocker(func: Callable | None = None, *, callable_param: int | str = 0) -> Callable:
    """The callable given at ``callable_param`` (a position or a keyword) runs away from the event loop."""
    return _same if func is None else _same(func)
