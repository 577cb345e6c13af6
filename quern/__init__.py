"""quern: a PySpark-native analytics engine."""

from quern.errors import BindError, ConstraintError, ParseError, QuernError, TransactionError
from quern.session import Engine, Prepared, Result, Session, query
from quern.sources.files import ParquetTables
from quern.sources.shared import release

__all__ = ["BindError", "ConstraintError", "Engine", "ParquetTables", "ParseError", "Prepared", "QuernError", "Result", "Session", "TransactionError", "query", "release"]
