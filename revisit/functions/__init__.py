from revisit.functions.columns import (  # noqa: F401
    epoch_micros, floor_div, epoch_seconds, nan_to_null, safe_div,
    seconds_component, seconds_to_interval, hash_bucket, hex_prefix_int,
)
