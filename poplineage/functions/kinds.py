"""Event kinds: a small code in the log, a label in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code of each event kind.
KINDS = {
    "NONE": 0,
    "CREATED": 1,
    "REMOVED": 2,
    "MODIFIED": 3,
    "TRANSFORMED": 4,
    "JUMPED_OUT": 5,
    "JUMPED_IN": 6,
}
# Fixed value: a second spelling that older logs use for code 5.
SECOND_SPELLING = {"JUPED_OUT": 5}
UNKNOWN_CODE = -1
UNKNOWN_LABEL = "invalid event kind"

CREATED, REMOVED, TRANSFORMED = KINDS["CREATED"], KINDS["REMOVED"], KINDS["TRANSFORMED"]


def _lookup(pairs, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def kind_code(label: Column) -> Column:
    return _lookup({**KINDS, **SECOND_SPELLING}.items(), label, UNKNOWN_CODE)


def kind_label(code: Column) -> Column:
    return _lookup(((code_, name) for name, code_ in KINDS.items()), code, UNKNOWN_LABEL)
