from creditloom.functions.aggregates import (
    all_flag, any_flag, avg_where, count_if, pct_share, share, span, weighted_avg,
)
from creditloom.functions.expressions import (
    between_flag, bucketize, coalesce_key, code_to_int, cross_profile, days_to_years, diff,
    flag, like_flag, map_groups, ratio, score_conditions, sum_flags,
)

__all__ = [
    "all_flag", "any_flag", "avg_where", "between_flag", "bucketize", "coalesce_key",
    "code_to_int", "count_if", "cross_profile", "days_to_years", "diff", "flag", "like_flag",
    "map_groups", "pct_share", "ratio", "score_conditions", "share", "span",
    "sum_flags", "weighted_avg",
]
