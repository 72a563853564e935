"""Declared schemas of the tables that the jobs read and write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The six cell parameters, in the order of the result tables,
# each with the column that holds it in the event log.
PARAMS = (
    "birthEfficiency",
    "birthResistance",
    "lifespanEfficiency",
    "lifespanResistance",
    "successEfficiency",
    "successResistance",
)
PARAM_COLUMNS = (
    "birth_efficiency",
    "birth_resistance",
    "lifespan_efficiency",
    "lifespan_resistance",
    "success_efficiency",
    "success_resistance",
)
AXES = ("x", "y", "z")

# Columns of an event log, in the order of the file.
_LOG_FIELDS = (
    ("position_0", T.FloatType()),
    ("position_1", T.FloatType()),
    ("position_2", T.FloatType()),
    ("density", T.FloatType()),
    ("next_event_time", T.DoubleType()),
    ("next_event_kind", T.IntegerType()),
    ("birth_efficiency", T.FloatType()),
    ("birth_resistance", T.FloatType()),
    ("lifespan_efficiency", T.FloatType()),
    ("lifespan_resistance", T.FloatType()),
    ("success_efficiency", T.FloatType()),
    ("success_resistance", T.FloatType()),
    ("mutation_id", T.LongType()),
    ("birth_rate", T.FloatType()),
    ("death_rate", T.FloatType()),
    ("success_probability", T.FloatType()),
    ("lifespan", T.FloatType()),
    ("event_time", T.DoubleType()),
    ("event_time_delta", T.IntegerType()),
    ("event_kind", T.IntegerType()),
)


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


EVENT_LOG = _struct(_LOG_FIELDS)
POSITION = _struct((axis, T.FloatType()) for axis in AXES)
CELL_PARAMS = _struct((name, T.FloatType()) for name in PARAMS)
EVENT_KIND = _struct([("encoded", T.IntegerType())])
CELL = _struct([("position", POSITION), ("mutationId", T.LongType()), ("cellParams", CELL_PARAMS)])
EVENT = _struct(
    [
        ("time", T.DoubleType()),
        ("timeDelta", T.IntegerType()),
        ("eventKind", EVENT_KIND),
        ("position", POSITION),
        ("mutationId", T.LongType()),
        ("cellParams", CELL_PARAMS),
    ]
)
CHRONICLE = _struct(
    [
        ("particleId", T.LongType()),
        ("parentId", T.LongType()),
        ("birthTime", T.DoubleType()),
        ("deathTime", T.DoubleType()),
        ("position", POSITION),
        ("mutationId", T.LongType()),
        ("cellParams", CELL_PARAMS),
    ]
)
# Columns of the initial-configuration file, which has no header line.
INITIAL_FILE = _struct(
    [
        ("x", T.FloatType()),
        ("y", T.FloatType()),
        ("z", T.FloatType()),
        ("event_id", T.LongType()),
        ("time", T.DoubleType()),
        ("delta_time", T.IntegerType()),
        ("event_kind", T.IntegerType()),
        ("mutation_id", T.LongType()),
        *((name, T.FloatType()) for name in PARAM_COLUMNS),
    ]
)
PARENT_FILE = _struct([("mutationId", T.LongType()), ("parentMutationId", T.LongType())])


def not_nullable(kind: T.DataType) -> T.DataType:
    """The same type with every struct field, at any depth, marked non-null."""
    if isinstance(kind, T.StructType):
        return T.StructType(
            [T.StructField(f.name, not_nullable(f.dataType), False, f.metadata) for f in kind.fields]
        )
    return kind


def null_check(kind: T.StructType, prefix: str = "") -> Column:
    """True where any field that ``not_nullable`` forbids to be null is null."""
    checks = F.lit(False)
    for field in kind.fields:
        column = F.col(f"{prefix}{field.name}")
        checks = checks | column.isNull()
        if isinstance(field.dataType, T.StructType):
            checks = checks | null_check(field.dataType, f"{prefix}{field.name}.")
    return checks


def require_not_null(df: DataFrame) -> DataFrame:
    """Fails the job on the first row that holds a null anywhere in ``df``'s structs."""
    message = F.lit("null value in a column declared non-null")
    return df.filter(F.when(null_check(df.schema), F.raise_error(message).cast("boolean")).otherwise(True))
