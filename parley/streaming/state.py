"""Helpers for keyed state."""

from __future__ import annotations


def replace_list(state, rows: list[tuple]) -> None:
    """Set a list state; an empty list is not a legal value and clears it."""
    if rows:
        state.put(rows)
    elif state.exists():
        state.clear()
