"""Errors of slides, as the Python exceptions that callers would expect; a missing file is Python's own FileNotFoundError."""


class SlideError(Exception):
    """Anything wrong with a slide."""


class TiffError(SlideError, ValueError):
    pass


class UnsupportedFormat(SlideError, ValueError):
    pass


class InvalidMetadata(SlideError, ValueError):
    pass


class OutOfBounds(SlideError, IndexError):
    pass


class LevelOutOfBounds(OutOfBounds):
    pass


class TileOutOfBounds(OutOfBounds):
    pass


class ResourceError(SlideError, RuntimeError):
    pass


class ReportError(SlideError, RuntimeError):
    pass


_KNOWN = {c.__name__: c for c in (TiffError, UnsupportedFormat, InvalidMetadata, OutOfBounds, LevelOutOfBounds, TileOutOfBounds, ResourceError, ReportError, FileNotFoundError, PermissionError, OSError)}


def from_row(text: str) -> Exception:
    """The exception that an error row's text (name: message) tells of."""
    name, _, message = text.partition(": ")
    return _KNOWN.get(name, SlideError)(message if name in _KNOWN else text)
