"""Key and record types.

Unsigned integers have no Spark type of their own: each is held in the next wider
signed type and checked against its range when it is stored.
"""

from __future__ import annotations

from decimal import Decimal
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    """A type's name, Spark type and, for integers, largest value."""

    BINARY = ("binary", T.BinaryType(), None)
    TEXT = ("text", T.StringType(), None)
    UINT8 = ("uint8", T.ShortType(), 2**8 - 1)
    UINT16 = ("uint16", T.IntegerType(), 2**16 - 1)
    UINT32 = ("uint32", T.LongType(), 2**32 - 1)
    UINT64 = ("uint64", T.DecimalType(20, 0), 2**64 - 1)
    REAL32 = ("real32", T.FloatType(), None)
    REAL64 = ("real64", T.DoubleType(), None)
    INT32 = ("int32", T.IntegerType(), None)
    INT64 = ("int64", T.LongType(), None)
    TIMESTAMP = ("timestamp", T.TimestampType(), None)

    @property
    def spark(self) -> T.DataType:
        return self.value[1]

    @property
    def most(self) -> int | None:
        return self.value[2]

    @property
    def numeric(self) -> bool:
        return self not in (Kind.BINARY, Kind.TEXT, Kind.TIMESTAMP)

    @property
    def real(self) -> bool:
        return self in (Kind.REAL32, Kind.REAL64)

    def stored(self, column: Column) -> Column:
        """The column in this type; a value out of an unsigned type's range raises when the plan runs."""
        if self.most is None:
            return column.cast(self.spark)
        wide = column.cast("decimal(38,0)")
        fits = wide.isNull() | wide.between(F.lit(0), F.lit(Decimal(self.most)).cast("decimal(20,0)"))
        return F.when(fits, wide.cast(self.spark)).otherwise(F.raise_error(F.lit(f"value out of range for {self.value[0]}")).cast(self.spark))

    def size(self, column: Column) -> Column:
        """Bytes that a value of this type takes: those of the type, or of its own text or bytes."""
        return F.lit(SIZES[self]).cast("long") if self in SIZES else F.octet_length(column).cast("long")


#: Bytes of a value of each type of fixed size.
SIZES = {Kind.UINT8: 1, Kind.UINT16: 2, Kind.UINT32: 4, Kind.UINT64: 8, Kind.REAL32: 4, Kind.REAL64: 8, Kind.INT32: 4, Kind.INT64: 8, Kind.TIMESTAMP: 8}
