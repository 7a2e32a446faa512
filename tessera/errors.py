"""Errors that the engine raises itself, and the classes of all errors that a query can end with."""

from __future__ import annotations

from enum import Enum

from py4j.protocol import Py4JNetworkError
from pyspark.errors import AnalysisException, ArithmeticException, ParseException, PySparkException


class EngineError(ValueError):
    """A request that cannot be carried out as stated."""


class UnknownTable(EngineError):
    pass


class UnknownColumn(EngineError):
    pass


class ModelError(EngineError):
    """A semantic model, or a question put to it, does not hold together."""


class MissingIdentity(EngineError):
    """A session function or policy was used without a session context."""


class ErrorClass(Enum):
    """Who has to act, and whether running again can help."""

    #: the request is wrong: its text, its names, its types or a value that a cast cannot take
    USER = "user"
    NOT_FOUND = "not_found"
    DENIED = "denied"
    #: the cluster ran short or lost too many executors: may work when run again
    RESOURCES = "resources"
    INTERNAL = "internal"

    @property
    def retryable(self) -> bool:
        return self is ErrorClass.RESOURCES


_NOT_FOUND = ("TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST", "SCHEMA_NOT_FOUND", "UNRESOLVED_COLUMN", "ROUTINE_NOT_FOUND", "UNRESOLVED_ROUTINE")
_SHORT = ("OutOfMemoryError", "ExecutorLostFailure", "FetchFailed", "No space left on device", "UNABLE_TO_ACQUIRE_MEMORY", "exceeds spark.driver.maxResultSize")
_DENIED = ("AccessControlException", "Permission denied", "AccessDenied")


def classify(error: BaseException) -> ErrorClass:
    """The class of an error: by its type and Spark's error condition, else by the failure that its message reports."""
    if isinstance(error, MissingIdentity):
        return ErrorClass.DENIED
    if isinstance(error, (UnknownTable, UnknownColumn)):
        return ErrorClass.NOT_FOUND
    if isinstance(error, EngineError):
        return ErrorClass.USER
    if isinstance(error, (MemoryError, Py4JNetworkError)):
        return ErrorClass.RESOURCES
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    text = str(error)
    if condition.startswith(_NOT_FOUND):
        return ErrorClass.NOT_FOUND
    if any(x in text for x in _DENIED):
        return ErrorClass.DENIED
    if any(x in text for x in _SHORT):
        return ErrorClass.RESOURCES
    if isinstance(error, (AnalysisException, ParseException, ArithmeticException)) or (condition and not condition.startswith("INTERNAL_ERROR")):
        return ErrorClass.USER
    return ErrorClass.INTERNAL
