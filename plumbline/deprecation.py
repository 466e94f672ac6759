"""Warnings about names that will go."""

from __future__ import annotations

import warnings


def warn_deprecated(name: str, *, since: str, remove_in: str, replacement: str | None = None, stacklevel: int = 2) -> None:
    advice = f"; use {replacement}" if replacement else ""
    warnings.warn(f"{name} is deprecated since {since} and goes in {remove_in}{advice}", DeprecationWarning, stacklevel=stacklevel + 1)
