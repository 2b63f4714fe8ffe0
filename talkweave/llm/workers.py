"""What a Python worker keeps between tasks.

Workers live as long as their executor and serve the tasks of all operators in turn, so a large object (a tokenizer with its
words, automata) is kept only until a task of another kind needs the memory.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_held: dict[Hashable, Any] = {}


def hold(key: Hashable, build: Callable[[], Any]) -> Any:
    """The object of this key, built if it isn't held; whatever else is held goes."""
    if key not in _held:
        drop()
        _held[key] = build()
    return _held[key]


def drop() -> None:
    """Keep nothing."""
    _held.clear()
