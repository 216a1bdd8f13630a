"""What can go wrong, by kind."""


class TesseraError(Exception):
    """Base of all errors of this library."""


class InvalidStatement(TesseraError):
    """A query or mutation that contradicts itself or the schema."""


class InvalidSchema(TesseraError):
    """A model declaration that can't be linked."""


class ValidationFailed(TesseraError):
    """A value breaks a constraint of its field."""


class RecordNotFound(TesseraError):
    """A row that must exist doesn't."""


class ConditionFailed(TesseraError):
    """A guarded write met a row that doesn't meet its condition."""


class UniqueViolation(TesseraError):
    """A write would repeat a unique key."""


class UnsupportedFeature(TesseraError):
    """Asked for something that this engine or a connector doesn't do."""


class ReadOnlyTransaction(TesseraError):
    """A write in a read-only transaction."""


class SerializationFailure(TesseraError):
    """A commit found that a table has changed since the transaction read it."""
