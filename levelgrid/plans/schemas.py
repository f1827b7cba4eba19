"""Fixed schemas and enumerations: one place that names every column."""

from __future__ import annotations

from pyspark.sql import types as T


POINT = "struct<x:double,y:double>"
REF = "struct<type:string,id:string,edge:string>"

_POINTS = ("scan_id string, point_id bigint, x double, y double, z double, nx double, ny double, nz double, r smallint, g smallint, b smallint")
_TRIANGLES = ("scan_id string, face_id bigint, " + ", ".join(f"{c}{d} double" for c in "abc" for d in "xyz"))
_NODES = ("scan_id string, node_id string, m array<double>")
_SCAN_META = ("scan_id string, unit_scale double, source_format string")

LEVEL = (
    "struct<id:string,name:string,elevation:double,ceilingHeight:double,"
    "vertices:array<struct<id:string,x:double,y:double>>,"
    "walls:array<struct<id:string,a:string,b:string,thickness:double,kind:string,confidence:double>>,"
    "openings:array<struct<id:string,wall:string,kind:string,offset:double,width:double,sill:double,head:double,swing:string,swingSide:string,confidence:double>>,"
    "columns:array<struct<id:string,x:double,y:double,width:double,depth:double,rotationDeg:double>>,"
    f"stairs:array<struct<id:string,outline:array<{POINT}>,direction:{POINT},riserCount:int,fromElevation:double,toElevation:double>>,"
    f"rooms:array<struct<id:string,name:string,number:string,seed:{POINT}>>,"
    "separators:array<struct<id:string,a:string,b:string>>,"
    "fixtures:array<struct<id:string,symbol:string,x:double,y:double,rotationDeg:double,width:double,depth:double,confidence:double,role:string>>,"
    "texts:array<struct<id:string,x:double,y:double,text:string,heightM:double>>,"
    f"dimensions:array<struct<id:string,auto:boolean,offset:double,segments:array<struct<a:{REF},b:{REF}>>>>,"
    "suppressedAutoDimensions:array<string>>"
)
ISSUE = "struct<id:string,severity:string,code:string,message:string,levelId:string,elementId:string>"
_PLAN = (
    "schemaVersion int, units string, revision int,"
    "project struct<name:string,address:string,northAngleDeg:double>,"
    f"levels array<{LEVEL}>,"
    "sheet struct<paper:string,orientation:string,scale:int,titleBlock:struct<company:string,project:string,address:string,drawnBy:string,date:string,sheetTitle:string,sheetNumber:string,revisionNote:string>>,"
    f"detection struct<source:struct<filename:string,format:string,unitScaleToMeters:double,upAxis:string,manhattanAngleDeg:double,linked:boolean>,issues:array<{ISSUE}>>"
)
_MANIFEST = ("file string, source string, kind string, notes string, levels int, references array<struct<name:string,lengthM:double,toleranceM:double>>")
_PROJECT = ("id string, name string, createdAt string, sourceFileName string, linkedPath string, fileId string, versionId string")

# The document's enumerations and patterns.
ID_PATTERN = "^[A-Za-z][A-Za-z0-9_-]{0,31}$"
ISSUE_CODES = [
    "gravity_uncertain", "units_guessed", "non_manhattan", "assumed_thickness", "open_gap", "uncertain_room",
    "room_seed_lost", "room_not_split", "low_confidence_opening", "missing_source", "ceiling_missing",
]
SYMBOLS = [
    "toilet", "sink", "bathtub", "shower", "kitchen-counter", "stove", "bed-double", "sofa", "table", "wardrobe", "block", "chair",
]
FIXTURE_SYMBOLS = ["toilet", "sink", "bathtub", "shower", "kitchen-counter", "stove"]
# Default width and depth of a placed symbol, and the sizes used when a reply gives none.
DRAW_SIZES = {"bed-double": (1.6, 2.0), "sofa": (2.0, 0.6), "kitchen-counter": (2.0, 0.6), "bathtub": (0.7, 1.7), "table": (1.2, 0.8), "wardrobe": (1.2, 0.6), "toilet": (0.4, 0.7)}
REPLY_SIZES = {
    "toilet": (0.4, 0.7), "sink": (0.6, 0.6), "bathtub": (0.7, 1.7), "shower": (0.9, 0.9), "kitchen-counter": (2.0, 0.6), "stove": (0.6, 0.6),
    "bed-double": (1.6, 2.0), "sofa": (2.0, 0.6), "table": (1.2, 0.8), "wardrobe": (1.2, 0.6), "block": (0.6, 0.6), "chair": (0.5, 0.5),
}
WALL_KINDS = ["exterior", "interior", "partition", "assumed"]
OPENING_KINDS = ["door", "window", "passage"]
SWINGS = ["left", "right", "double", "sliding", "none"]
SWING_SIDES = ["positive", "negative"]
PAPERS = ["A4", "A3", "A2", "A1"]
ORIENTATIONS = ["landscape", "portrait"]
SCALES = [50, 100, 200]
FORMATS = ["glb", "hand"]
AXES = ["x", "y", "z"]
SEVERITIES = ["info", "warning", "error"]



_DDL = {"POINTS": _POINTS, "TRIANGLES": _TRIANGLES, "NODES": _NODES, "SCAN_META": _SCAN_META, "PLAN": _PLAN, "MANIFEST": _MANIFEST, "PROJECT": _PROJECT}


def __getattr__(name: str) -> T.StructType:
    """Struct types by name, parsed when first asked for (parsing needs a session)."""
    if name not in _DDL:
        raise AttributeError(name)
    return T.StructType.fromDDL(_DDL[name])


def with_corrupt(name: str, column: str = "_bad") -> T.StructType:
    """A schema with a column for the text of rows that do not parse."""
    return T.StructType([*__getattr__(name).fields, T.StructField(column, T.StringType())])
