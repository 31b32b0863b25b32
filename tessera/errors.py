"""What the dialect's front end raises. Every error names what is wrong with the query text."""


class QueryError(Exception):
    """A query that can't be run."""


class SyntaxQueryError(QueryError):
    """The text isn't a sentence of the dialect."""


class UnknownTable(QueryError):
    """A table that isn't registered, or isn't in FROM."""


class DuplicateTable(QueryError):
    """A table stands twice in FROM; the dialect has no aliases."""


class UnknownColumn(QueryError):
    """A column that its table lacks."""


class TypeMismatch(QueryError):
    """Operands that can't be compared, or a literal that isn't of its column's type."""


class AggregateMisuse(QueryError):
    """An aggregate where none may stand, or a plain column beside aggregates that isn't a group key."""


class OrderMisuse(QueryError):
    """ORDERBY on a column that isn't there any more."""
