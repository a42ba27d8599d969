"""Imports every module that registers queries."""

from tessera.plans import analytics, extensions, front_ends, languages, relational  # noqa: F401
