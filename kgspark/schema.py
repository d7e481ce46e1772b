"""Declared schemas of the stage tables, and the adapter that brings a frame into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**fields: str) -> T.StructType:
    kinds = {
        "string": T.StringType(),
        "int": T.IntegerType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "strings": T.ArrayType(T.StringType()),
        "floats": T.ArrayType(T.FloatType()),
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


DOCUMENTS = _struct(id="string", text="string", title="string")
TEXT_UNITS = _struct(id="string", chunk_id="string", document_ids="strings", chunk="string", n_tokens="int")
ENTITIES = _struct(
    id="string", name="string", type="string", description="string", human_readable_id="long", page="long", text_unit_ids="strings"
)
NODES = _struct(
    level="int", title="string", type="string", description="string", community="string", degree="long",
    human_readable_id="long", id="string", size="long", top_level_node_id="string", x="double", y="double",
)
RELATIONSHIPS = _struct(
    source="string", target="string", weight="double", description="string", page="long", text_unit_ids="strings", id="string",
    human_readable_id="string", source_degree="long", target_degree="long", rank="long",
)
COMMUNITIES = _struct(
    id="string", title="string", level="int", raw_community="string", page="long", relationship_ids="strings", text_unit_ids="strings"
)
COVARIATES = _struct(
    id="string", subject_id="string", object_id="string", type="string", status="string", start_date="string", end_date="string",
    description="string",
)
REPORTS = _struct(
    level="int", community="string", title="string", summary="string", full_content="string", full_content_json="string",
    rank="double", rank_explanation="string", id="string",
)


def enforce_schema(
    df: DataFrame, schema: T.StructType, names: dict[str, str] | None = None, attributes: list[str] | None = None, strict: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows in the schema, rejects): columns renamed and cast, the rest as an attribute map.

    ``names`` maps schema fields to source columns; a column the source lacks
    is null. A row in which a field of ``strict`` is null, or does not cast, is
    a reject and keeps its source columns.
    """
    names = names or {}
    source = {f.name: names.get(f.name, f.name) for f in schema.fields}
    typed = {
        f.name: (F.col(source[f.name]).try_cast(f.dataType) if source[f.name] in df.columns else F.lit(None).cast(f.dataType))
        for f in schema.fields
    }
    bad = F.lit(False)
    for name in strict or []:
        bad = bad | typed[name].isNull()
    columns = [c.alias(n) for n, c in typed.items()]
    if attributes is not None:
        pairs = [x for a in attributes for x in (F.lit(a), F.col(a).cast("string"))]
        columns.append((F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attributes"))
    return df.filter(~bad).select(*columns), df.filter(bad)
