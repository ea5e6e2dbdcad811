"""What can go wrong when documents are parsed, one class for each stage.

Operators don't raise these for a single document: its row says what happened, with the class's name in ``error_class``.
They are raised where a whole run can't go on, such as a renderer that isn't installed.
"""

from __future__ import annotations


class ParsingError(Exception):
    """Any failure of parsing."""


class ModelLoadError(ParsingError):
    """A model can't be loaded."""


class ImageExtractionError(ParsingError):
    """A document gives no page images."""


class LayoutError(ParsingError):
    """A page's layout can't be found."""


class RecognitionError(ParsingError):
    """An element can't be read."""


class OutputError(ParsingError):
    """Results can't be written."""


class ValidationError(ParsingError):
    """Input doesn't have what a stage needs."""
