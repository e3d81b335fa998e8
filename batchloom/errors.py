"""Exception hierarchy of the library."""

from __future__ import annotations


class BatchloomError(Exception):
    """Base of every error that the library raises on purpose."""


class SpecError(BatchloomError):
    """A table specification is invalid; ``errors`` lists every problem found."""

    def __init__(self, errors: list[str]):
        self.errors = list(errors)
        super().__init__("; ".join(self.errors))


class UnsupportedType(BatchloomError):
    """A column type lies outside the accepted type profile."""


class FormatError(BatchloomError):
    """Stored metadata (manifest, name, watermark) is malformed."""


class SegmentFull(BatchloomError):
    """A writer limited to one segment has used all of its batches."""


class StateError(BatchloomError):
    """An operation is not allowed in the writer's present state."""
