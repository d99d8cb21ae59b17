"""Sorted boundaries of a sort key, held as one literal in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditpath.functions.columns import MAX_BOUNDS

# Both directions keep microseconds, so that boundaries come back as they were.
_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def literal_array(array: DataFrame) -> tuple[Column, int]:
    """The sorted, distinct entries of a one-row, one-column array table, and their number.

    The array comes to the driver, so it must be of bounded length.
    """
    name = array.columns[0]
    kind = array.schema[0].dataType.simpleString()
    found = array.select(F.to_json(name, _FORMATS).alias("text"), F.size(name).alias("size")).first()
    values = F.from_json(F.lit(found["text"] or "[]"), kind, _FORMATS)
    if (found["size"] or 0) > MAX_BOUNDS:
        raise ValueError(f"{found['size']} boundaries; at most {MAX_BOUNDS} can be searched")
    return F.sort_array(F.array_distinct(values)), found["size"] or 0
