"""Errors that callers may want to tell apart."""


class CubeError(Exception):
    """Base of this package's errors."""


class QueryError(CubeError, ValueError):
    """A query document that can't be answered: unknown column, operator, function, literal or table."""


class WarehouseError(CubeError):
    """A missing, incomplete or unfitting warehouse or input folder."""
