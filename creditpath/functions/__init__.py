from creditpath.functions.columns import (
    calendar_features,
    ctr_of_rank,
    exact_mean,
    exact_sum,
    hash01,
    like_of_stars,
    lookup,
    path_transitions,
    position_in,
    ratio,
    tile_of_row,
)

__all__ = [
    "calendar_features", "ctr_of_rank", "exact_mean", "exact_sum", "hash01", "like_of_stars", "lookup",
    "path_transitions", "position_in", "ratio", "tile_of_row",
]
