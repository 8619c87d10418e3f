"""Schemas and fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the data model.
THREAT_TYPES = ("L", "I", "Nr", "D", "Dd", "U", "Nc")
TYPE_NAMES = {"L": "Linking", "I": "Identifying", "Nr": "Non-repudiation", "D": "Detecting", "Dd": "Data Disclosure", "U": "Unawareness", "Nc": "Non-compliance"}
ELEMENT_TYPES = ("ExternalEntity", "Process", "DataStore")
POSITIONS = ("S", "fl", "D")
#: Interactions of element types that can carry a threat; each takes every threat type at every position.
VALID_PAIRS = (("Process", "Process"), ("Process", "DataStore"), ("Process", "ExternalEntity"), ("DataStore", "Process"), ("ExternalEntity", "Process"))
#: The thirteen parent categories of the second framework.
CATEGORIES = tuple(f"PA{n:02d}" for n in range(1, 14))
#: Constructs that can be evidence for an element of a type.
SUPPORTING = {
    "DataStore": ("mongoose_model", "mongoose_schema", "mongo_collection", "fs_write", "fs_location", "express_static_mount", "web_storage_access", "db_connect"),
    "Process": ("express_mount", "express_route", "db_operation", "db_access", "auth_middleware", "jwt_operation", "password_hash", "multer_use", "http_client_config", "http_route_binding"),
    "ExternalEntity": ("role_check", "ui_component", "http_client_call", "http_route_binding"),
}
LABELS = ("spurious", "valid_uncatalogued", "borderline")
FEASIBILITY = {"Plausible": "Med", "Likely": "High", "Unlikely": "Low"}

CHUNK = "id string, text string, source string, doc string, section string, meta struct<kind:string,threat_type:string,tree_node:string,src:string,dst:string,panoptic_id:string,parent_activity:string,threat_id:bigint,linddun_types:array<string>>"
PROVENANCE = "array<struct<fact_id:string,file:string,line:int,bbox:array<int>,label_text:string>>"
ELEMENT = f"id string, type string, name string, trust_boundary string, provenance {PROVENANCE}"
FLOW = f"id string, source string, destination string, description string, crosses_boundaries array<string>, provenance {PROVENANCE}"
DFD = f"_meta struct<scenario:string,schema_version:int>, elements array<struct<{', '.join(x.replace(' ', ':', 1) for x in ELEMENT.split(', '))}>>, flows array<struct<{', '.join(x.replace(' ', ':', 1) for x in FLOW.split(', '))}>>, trust_boundaries array<struct<id:string,name:string,contains:array<string>>>"
THREAT = "flow_id string, originator_id string, threat_type string, tree_node string, title string, description string, assumptions string, severity string, likelihood string, uncertainty_note string, position string, grounded boolean, mode string, panoptic_action string"
GOLD = "id int, interaction string, dfd_source_id string, dfd_destination_id string, originator_id string, threat_type string, tree_node string, title string, description string, assumptions string, severity string, likelihood string, panoptic_actions array<string>, ranking_value double"
FACT = "id string, construct string, file string, line int, end_line int, fields map<string,string>, derived boolean, confidence string"


#: Bytes of a file whose rows are dealt to all cores.
SMALL = 64_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table of one small file dealt to all cores, as its only row group would be one task's work.

    Tables of several files or of more than SMALL bytes are left as they are: their row groups are tasks enough.
    """
    if len(df.inputFiles()) != 1 or int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())) > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table of fixed rows."""
    return spark.createDataFrame(rows, schema)


def mapping(spark: SparkSession) -> DataFrame:
    """(source_type, dest_type, threat_type, position) of every valid interaction."""
    return literal(spark, [(a, b, t, p) for a, b in VALID_PAIRS for t in THREAT_TYPES for p in POSITIONS], "source_type string, dest_type string, threat_type string, position string")


def invalid_pairs(spark: SparkSession) -> DataFrame:
    """(source, destination, reason) of interactions that are excluded by name."""
    rows = [("DataStore", "DataStore", "data stores exchange no data without a process"), ("ExternalEntity", "ExternalEntity", "flows between external entities are not modelled")]
    return literal(spark, rows, "source string, destination string, reason string")


def supporting(spark: SparkSession) -> DataFrame:
    """E-12: (type, construct)."""
    return literal(spark, [(t, c) for t, cs in SUPPORTING.items() for c in cs], "type string, construct string")
