"""Errors with the command language's codes."""

from __future__ import annotations

#: Error codes and their names. Codes without an entry are named Location<code>.
NAMES = {
    2: "BadValue",
    9: "FailedToParse",
    14: "TypeMismatch",
    40: "ConflictingUpdateOperators",
    43: "CursorNotFound",
    48: "NamespaceExists",
    50: "MaxTimeMSExpired",
    59: "CommandNotFound",
    66: "ImmutableField",
    73: "InvalidNamespace",
    168: "InvalidPipelineOperator",
    238: "NotImplemented",
    11000: "DuplicateKey",
}


class DocumentError(ValueError):
    """A command that can't be run, with its code, name and message."""

    def __init__(self, code: int, message: str):
        self.code, self.name = code, NAMES.get(code, f"Location{code}")
        super().__init__(f"{self.name} ({code}): {message}")


def bad_value(message: str) -> DocumentError:
    return DocumentError(2, message)
