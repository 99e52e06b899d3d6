"""Ways of running an operator that keep one hot group from landing in one task."""

from cohortry.plans.ordered import (
    DEFAULT_GROUP_ROWS,
    largest_group_rows,
    nulls_last,
    numbered,
    running_totals,
)
from cohortry.plans.outer import full_outer_chain, outer_join
from cohortry.plans.splittable import group_for_join

__all__ = [
    "DEFAULT_GROUP_ROWS", "full_outer_chain", "group_for_join", "largest_group_rows", "nulls_last", "numbered", "outer_join", "running_totals",
]
