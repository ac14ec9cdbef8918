"""Column functions: text, time, numbers, arrays and records."""

from tracewell.functions.arrays import (  # noqa: F401
    argmax,
    argsort,
    clip_to,
    mask_by,
    max_abs,
    moments,
    pad_to,
    percentile_of,
)
from tracewell.functions.numbers import clamp, decibel, guarded_ratio, truncate  # noqa: F401
from tracewell.functions.times import add_seconds, iso, parse_slashed, parts, seconds_between  # noqa: F401
