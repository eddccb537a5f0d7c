"""Immutable predicates on one column, and their conjunction."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from slabscan.types import literal


@dataclass(frozen=True)
class Predicate:
    """Base class; ``name`` is a column of the table."""

    name: str

    def column(self) -> Column:
        raise NotImplementedError

    def verdict(self, low: Column, high: Column) -> Column:
        """NONE, ALL or PARTIAL for a block whose column spans [low, high]."""
        none, every = self._none(low, high), self._every(low, high)
        return F.when(none, "NONE").when(every, "ALL").otherwise("PARTIAL")

    def _none(self, low: Column, high: Column) -> Column:
        raise NotImplementedError

    def _every(self, low: Column, high: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Eq(Predicate):
    value: Any

    def column(self):
        return F.col(self.name) == literal(self.value)

    def _none(self, low, high):
        return (literal(self.value) < low) | (literal(self.value) > high)

    def _every(self, low, high):
        return (low == literal(self.value)) & (high == literal(self.value))


@dataclass(frozen=True)
class Gt(Predicate):
    value: Any

    def column(self):
        return F.col(self.name) > literal(self.value)

    def _none(self, low, high):
        return high <= literal(self.value)

    def _every(self, low, high):
        return low > literal(self.value)


@dataclass(frozen=True)
class Lt(Predicate):
    value: Any

    def column(self):
        return F.col(self.name) < literal(self.value)

    def _none(self, low, high):
        return low >= literal(self.value)

    def _every(self, low, high):
        return high < literal(self.value)


@dataclass(frozen=True)
class Between(Predicate):
    """Both bounds belong to the range; a reversed range is empty."""

    low: Any
    high: Any

    def column(self):
        return F.col(self.name).between(literal(self.low), literal(self.high))

    def _none(self, low, high):
        return (high < literal(self.low)) | (low > literal(self.high)) | (literal(self.low) > literal(self.high))

    def _every(self, low, high):
        return (low >= literal(self.low)) & (high <= literal(self.high))


def conjunction(predicates: Iterable[Predicate]) -> Column:
    """AND of all predicates, in their order; no predicate keeps every row."""
    return functools.reduce(operator.and_, (p.column() for p in predicates), F.lit(True))
