"""Error codes (data values) and the exceptions that carry them."""

from __future__ import annotations


class EngineError(Exception):
    """An error with a code."""

    def __init__(self, code: str, message: str = "", **arguments):
        super().__init__(f"{code}: {message}" if message else code)
        self.code, self.arguments = code, arguments


class FormatError(EngineError):
    """The file isn't what it claims to be, or of no kind that is read."""


class LimitError(EngineError):
    """A bound was passed."""


class StructureError(EngineError):
    """The file's sheet or header is not the one that was mapped."""


class PlanError(EngineError):
    """A mapping plan has faults; all of them are listed."""

    def __init__(self, faults: list[tuple[str, str]]):
        super().__init__(faults[0][0] if faults else "mapping.invalid-plan", "; ".join(f"{c} ({w})" for c, w in faults))
        self.faults = faults


class WriteError(EngineError):
    """A value or a sheet can't be written so that it reads back exactly."""
