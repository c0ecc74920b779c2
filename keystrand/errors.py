"""Errors, one class for each condition a caller may want to tell apart."""


class StoreError(Exception):
    """Any error of a database operation."""


class DatabaseNotFound(StoreError):
    pass


class DatabaseExists(StoreError):
    pass


class InvalidParameter(StoreError):
    pass


class InvalidKeyType(InvalidParameter):
    pass


class LimitsReached(StoreError):
    pass


class TransactionConflict(StoreError):
    pass


class WriteProtected(StoreError):
    pass


class CursorIsNil(StoreError):
    pass


class StatementError(StoreError):
    """A select names an unknown function or predicate, or applies one to a type it doesn't take."""


class PluginNotFound(StoreError):
    pass


class PluginExists(StoreError):
    pass
