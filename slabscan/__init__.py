"""slabscan: block-structured columnar scans on Spark DataFrames.

A table is clustered by a total order and cut into blocks of a fixed
capacity.  Queries are conjunctions of equality, range and BETWEEN predicates
that are answered as counts, per-block counts, positions or decoded columns.
Everything is an ordinary DataFrame plan; Catalyst and Parquet statistics do
the pushing down, pruning and skipping.
"""

from slabscan.operators.scan import BlockTable
from slabscan.predicate import Between, Eq, Gt, Lt, conjunction

__all__ = ["Between", "BlockTable", "Eq", "Gt", "Lt", "conjunction"]
