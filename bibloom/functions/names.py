"""Names of helper columns."""

from pyspark.sql import DataFrame


def unused(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no table has such a column in either case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
