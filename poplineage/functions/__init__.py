"""Column functions: event kinds, weighted aggregates, intervals over time points."""

from .aggregates import bin_number, dense_counts, fractions, shannon_term, weighted_avg, weighted_stddev
from .intervals import TimeGrid
from .kinds import CREATED, REMOVED, TRANSFORMED, kind_code, kind_label

__all__ = [
    "CREATED",
    "REMOVED",
    "TRANSFORMED",
    "TimeGrid",
    "bin_number",
    "dense_counts",
    "fractions",
    "kind_code",
    "kind_label",
    "shannon_term",
    "weighted_avg",
    "weighted_stddev",
]
