"""Exceptions of the public API. Every failure is closed: nothing partial is returned or published."""

from __future__ import annotations


class EvidenceError(RuntimeError):
    """Base of all expected errors."""


class ImportPolicyError(EvidenceError):
    """A source cannot be imported."""


class SnapshotError(EvidenceError):
    """A snapshot is missing or failed its audit."""


class SearchInputError(EvidenceError):
    """A request is outside the bounded read-only contract."""


class LibraryRegistryError(EvidenceError):
    """The library registry is invalid or refused a change."""


class VectorError(SnapshotError):
    """A vector build or its mapping is invalid."""


class EnhancedSearchError(EvidenceError):
    """The three-step search failed; ``audit`` lists the calls made so far, without any text."""

    def __init__(self, message, audit=None):
        super().__init__(message)
        given = audit or {}
        self.audit = {
            "simulated": given.get("simulated"),
            "call_count": given.get("call_count", 0),
            "calls": [dict(call) for call in given.get("calls", [])],
        }
