"""Typed errors of the public API (raised before a plan is built, where the input can be checked)."""


class OrreryError(ValueError):
    """Base of all errors of this package."""


class DimensionError(OrreryError):
    """A dimension or length that doesn't fit."""


class BadValueError(OrreryError):
    """A coordinate that isn't finite or is too large."""


class DuplicateIdError(OrreryError):
    """An id that is already there, or twice in a batch."""


class UnknownIdError(OrreryError, KeyError):
    """Ids of an allowlist that the index doesn't have."""


class CalibrationError(OrreryError):
    """A sample that can't calibrate."""


class IntegrityError(OrreryError):
    """Stored tables that don't belong together."""


class FilterError(OrreryError):
    """A filter that can't be compiled."""


class UnsupportedModeError(OrreryError, NotImplementedError):
    """A search mode that vector search doesn't have."""
