"""Refusals.  A guard that cannot answer raises; it never returns a guess."""


class SarMotionError(Exception):
    """Base of every refusal; ``code`` names its category."""

    code = "error"


class ArgumentError(SarMotionError):
    """A parameter, or a combination of parameters, has no meaning."""

    code = "arg"


class RangeFault(SarMotionError):
    """The request lies outside what the data or geometry supports."""

    code = "range"


class FormatFault(SarMotionError):
    """A file does not follow the layout it claims."""

    code = "format"


class UnsupportedFault(SarMotionError):
    """A valid product of a kind that is not read here."""

    code = "unsupported"


class MissingMetadata(SarMotionError):
    """A field the computation depends on is absent."""

    code = "missing_meta"


class SingularFault(SarMotionError):
    """A linear system, or a null distribution, has no solution."""

    code = "singular"


class IoFault(SarMotionError):
    """A file cannot be opened, read or written."""

    code = "io"
