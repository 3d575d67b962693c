"""What can go wrong, by the part that noticed."""


class EngineError(Exception):
    prefix = "error"

    def __str__(self) -> str:
        return f"{self.prefix}: {super().__str__()}"


class ConfigError(EngineError):
    prefix = "config error"


class IngestionError(EngineError):
    prefix = "ingestion error"


class StorageError(EngineError):
    prefix = "storage error"


class QueryError(EngineError):
    prefix = "query error"


class ExecutionError(EngineError):
    prefix = "execution error"


class FileError(EngineError):
    prefix = "io error"


class BoundError(ValueError):
    """A range bound that is no number and no RFC3339 time."""


class RequestError(EngineError):
    """A request body that never becomes a query; ``status`` is the HTTP status."""

    prefix = "request error"

    def __init__(self, message: str, status: int = 422):
        super().__init__(message)
        self.status = status
