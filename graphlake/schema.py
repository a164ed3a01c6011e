"""The relational envelope of property graphs."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _schema(text: str) -> StructType:
    kinds = {"bigint": LongType(), "int": IntegerType(), "string": StringType(), "float": FloatType(), "floats": ArrayType(FloatType())}
    parts = [field.split() for field in text.split(",")]
    return StructType([StructField(p[0], kinds[p[1]], p[2:] != ["not", "null"]) for p in parts])


NODE = _schema(
    "id bigint not null, project string not null, label string not null, name string not null, qualified_name string not null, file_path string, start_line int, end_line int, properties string"
)
EDGE = _schema("id bigint, project string not null, source_id bigint not null, target_id bigint not null, type string not null, properties string")
FILE_HASH = _schema("project string, rel_path string, sha256 string, mtime_ns bigint, size bigint")
NODE_VECTOR = _schema("node_id bigint, project string, vector floats")
TOKEN_VECTOR = _schema("project string, token string, vector floats, idf float")

ENVELOPE = tuple(NODE.fieldNames())
#: Node fields with a type of their own; all others are text.
NODE_TYPES = {f.name: f.dataType.simpleString() for f in NODE}
EDGE_TYPES = {f.name: f.dataType.simpleString() for f in EDGE}


def check(df, schema: StructType, what: str) -> None:
    """Raises ValueError where a column of the envelope is missing or has another type."""
    have = dict(df.dtypes)
    for f in schema:
        if f.name not in have:
            raise ValueError(f"{what}: column {f.name} is missing")
        if have[f.name] != f.dataType.simpleString():
            raise ValueError(f"{what}: column {f.name} is {have[f.name]}, not {f.dataType.simpleString()}")
