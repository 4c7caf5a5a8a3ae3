"""Connected components of a link table; the library's own, under this subpackage's name."""

from __future__ import annotations

from tutorlens.operators.components import components

__all__ = ["components"]
