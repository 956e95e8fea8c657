"""Registered queries: those of ``registry`` and, added to the same tables, those of ``records``."""

from skirmish.plans import records, registry

__all__ = ["records", "registry"]
