"""Typed errors; ``code`` is what callers branch on."""


class KvError(ValueError):
    code = "INVALID_ARGS"

    def __init__(self, message: str, code: str | None = None):
        super().__init__(message)
        if code:
            self.code = code


class QueryFormatError(KvError):
    code = "INVALID_QUERY_FORMAT"


class QueryFieldError(KvError):
    code = "INVALID_QUERY_FIELD"


class LimitError(KvError):
    code = "OVER_MAX_LIMITS"


class NotSupported(KvError):
    code = "NOT_SUPPORT"


class NotFound(KvError):
    code = "NOT_FOUND"


class Conflict(KvError):
    code = "DATA_CONFLICT"


class ConstraintError(KvError):
    code = "CONSTRAIN_VIOLATION"


class SchemaMismatch(KvError):
    code = "SCHEMA_MISMATCH"
