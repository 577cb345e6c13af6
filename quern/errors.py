"""Errors of the SQL layer."""


class QuernError(Exception):
    """Base of all errors that a statement can raise."""


class ParseError(QuernError):
    pass


class BindError(QuernError):
    pass


class ConstraintError(QuernError):
    pass


class TransactionError(QuernError):
    pass
