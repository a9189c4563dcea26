from .numeric import finite, finite_positive, null_if_not_finite, ratio
from .timegrid import DAY_US, HOUR_US, MINUTE_US, bucket_start, epoch_us, from_epoch_us, time_block

__all__ = [
    "DAY_US",
    "HOUR_US",
    "MINUTE_US",
    "bucket_start",
    "epoch_us",
    "finite",
    "finite_positive",
    "from_epoch_us",
    "null_if_not_finite",
    "ratio",
    "time_block",
]
