"""Plan building blocks shared by the operators: skew-safe joins, ranks that do
not funnel through one task, checked broadcasts and lineage cuts."""

from qloom.plans.keybits import key_bits, may_hold
from qloom.plans.lineage import cut_lineage, scratch_folder
from qloom.plans.ranking import (
    exact_median,
    first_by_hash,
    hash_cutoffs,
    hash_key,
    order_statistics,
    ranks_of_values,
    top_per_group,
)
from qloom.plans.sizing import inline_if_small, local_frame
from qloom.plans.skew import HOT_ROWS, hot_keys, lookup_join, most_rows, row_sample

__all__ = [
    "HOT_ROWS",
    "cut_lineage",
    "exact_median",
    "first_by_hash",
    "hash_cutoffs",
    "hash_key",
    "hot_keys",
    "inline_if_small",
    "key_bits",
    "local_frame",
    "lookup_join",
    "may_hold",
    "most_rows",
    "order_statistics",
    "ranks_of_values",
    "row_sample",
    "scratch_folder",
    "top_per_group",
]
