"""Typed errors of the semantic layer; all derive from SemanticError."""


class SemanticError(Exception):
    pass


class UnknownEntity(SemanticError):
    pass


class UnknownField(SemanticError):
    pass


class UnknownMeasure(SemanticError):
    pass


class UnknownQuery(SemanticError):
    pass


class NoPath(SemanticError):
    pass


class UnsafeJoinPath(SemanticError):
    pass


class UngroupedColumn(SemanticError):
    pass


class AmbiguousField(SemanticError):
    pass


class AmbiguousPath(SemanticError):
    pass


class AmbiguousDimensionRole(SemanticError):
    pass


class InvalidReference(SemanticError):
    pass


class InvalidModel(SemanticError):
    pass


class TypeMismatch(SemanticError):
    pass


class CyclicDependency(SemanticError):
    pass


class ColumnLineageCycle(SemanticError):
    pass


class NoAnchor(SemanticError):
    pass


class DimensionNotShared(SemanticError):
    pass


class QueryPlanError(SemanticError):
    pass


class ConstraintViolation(SemanticError):
    pass
