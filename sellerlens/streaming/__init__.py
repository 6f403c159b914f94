from sellerlens.streaming.incremental import (
    LostCheckpoint, compact, refresh_seller_day, sales_marts_from_partials, seller_day_from_partials,
)

__all__ = ["LostCheckpoint", "compact", "refresh_seller_day", "sales_marts_from_partials", "seller_day_from_partials"]
