"""Classes of objects: typed signals, nested parts, inheritance; and flattening of nested columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
)

#: The signal types and what holds them in Spark. Unsigned types are as wide as they need.
TYPES: dict[str, DataType] = {
    "Bool": BooleanType(),
    "Int8": ByteType(), "Int16": ShortType(), "Int32": IntegerType(), "Int64": LongType(), "Int": LongType(),
    "Int128": DecimalType(38, 0), "Int256": DecimalType(38, 0),
    "UInt8": ShortType(), "UInt16": IntegerType(), "UInt32": LongType(), "UInt64": DecimalType(20, 0), "UInt": DecimalType(20, 0),
    "UInt128": DecimalType(38, 0), "UInt256": DecimalType(38, 0),
    "Float16": FloatType(), "Float32": FloatType(), "Float64": DoubleType(), "Float": DoubleType(),
    "Fixed": DecimalType(38, 9), "UFixed": DecimalType(38, 9),
    "String": StringType(), "Bytes": BinaryType(),
}


@dataclass(frozen=True)
class ObjectClass:
    """A class: signals by name, each a type name or another class; signals of base come first.

    A signal may not repeat a name of base, and a class may not be among its own bases.
    """

    name: str
    signals: dict[str, str | ObjectClass] = field(default_factory=dict)
    base: ObjectClass | None = None

    def __post_init__(self):
        seen, at = {id(self)}, self.base
        while at is not None:
            if id(at) in seen:
                raise ValueError(f"class {self.name} inherits from itself")
            seen.add(id(at))
            at = at.base
        twice = set(self.signals) & set(self.base.all_signals() if self.base else {})
        if twice:
            raise ValueError(f"class {self.name} has signals of its base again: {sorted(twice)}")
        for s, kind in self.signals.items():
            if isinstance(kind, str) and kind not in TYPES:
                raise ValueError(f"signal {self.name}.{s} has the unknown type {kind}")

    def all_signals(self) -> dict[str, str | ObjectClass]:
        return {**(self.base.all_signals() if self.base else {}), **self.signals}

    def struct(self) -> StructType:
        """The class as a nested Spark type."""
        return StructType([StructField(s, TYPES[k] if isinstance(k, str) else k.struct()) for s, k in self.all_signals().items()])

    def leaves(self, prefix: str = "") -> dict[str, str]:
        """Leaf signals by dotted name, and their type names."""
        out: dict[str, str] = {}
        for s, k in self.all_signals().items():
            if isinstance(k, str):
                out[prefix + s] = k
            else:
                out |= k.leaves(f"{prefix}{s}.")
        return out


def flatten_signals(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct columns as one column per leaf, named by its path."""

    def leaves(column: Column, name: str, kind: DataType) -> list[Column]:
        if isinstance(kind, StructType):
            return [x for f in kind.fields for x in leaves(column.getField(f.name), f"{name}{separator}{f.name}", f.dataType)]
        return [column.alias(name)]

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)])
