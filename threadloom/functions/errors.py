"""Errors that carry a fixed code and never a value."""

from __future__ import annotations

import re


class CodeError(ValueError):
    """``str(error)`` is an upper-case code."""

    def __init__(self, code: str):
        if not isinstance(code, str) or not re.fullmatch("[A-Z][A-Z0-9_]*", code):
            raise ValueError("ERROR_CODE_INVALID")
        super().__init__(code)


class ConfigError(CodeError):
    pass


class DiscoveryError(CodeError):
    pass


class JsonError(CodeError):
    pass


class GateError(CodeError):
    pass


def need(ok: object, code: str, kind: type[CodeError] = GateError) -> None:
    if not ok:
        raise kind(code)


def safe_code(error: BaseException) -> str:
    """A code of ours, wherever in a chain or a worker's message it is, or else the type's name."""
    seen = error
    while seen is not None:
        if isinstance(seen, CodeError):
            return str(seen)
        seen = seen.__cause__ or seen.__context__
    found = re.search(r"(?:CodeError|ConfigError|DiscoveryError|JsonError|GateError): ([A-Z][A-Z0-9_]*)\b", str(error))
    return found[1] if found else type(error).__name__
