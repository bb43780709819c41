"""Errors of the masks, metrics and searches; raised before any job where the schema or the arguments tell."""


class InputError(Exception):
    """An argument that doesn't fit the table or isn't known."""


class DataTypeError(Exception):
    """A column of a kind that the operator can't use."""


class SumNotEqualToOneError(ValueError):
    """Probabilities or weights that don't sum to 1."""


class NotInRangeError(ValueError):
    """A number outside its range."""


class LessThanZeroError(ValueError):
    """A number below zero."""


class LessThanOrEqualToZeroError(ValueError):
    """A number that must be positive."""


class NoMutationAvailableError(ValueError):
    """A search without a mask left."""
