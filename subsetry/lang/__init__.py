"""The configuration language: text to statements."""

from .parser import parse
from .syntax import LanguageError, Problem

__all__ = ["LanguageError", "Problem", "parse"]
