from tarmac.functions.labels import (
    ladder,
    lbl,
    month_name,
    rag,
    route,
    season,
    time_of_day,
    two_axis,
)
from tarmac.functions.numeric import (
    as_bigint,
    exact,
    floor_div,
    hhmm_hour,
    nan_to_null,
    pct,
    pct_text,
    r2,
    rnd,
)

__all__ = [
    "as_bigint",
    "exact",
    "floor_div",
    "hhmm_hour",
    "ladder",
    "lbl",
    "month_name",
    "nan_to_null",
    "pct",
    "pct_text",
    "r2",
    "rag",
    "rnd",
    "route",
    "season",
    "time_of_day",
    "two_axis",
]
