"""Fixed catalogues as small local relations.

All of them hold at most a few dozen constant rows, so they are always safe to broadcast; a local
relation also tells the optimizer its exact size.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

DIM_ROWS = {
    "dim_cwe": (["cwe", "cwe_name", "severity", "score", "owasp", "description", "recommendation"], fixed.CWE_CATALOGUE),
    "dim_remediation": (["cwe", "root_cause", "why_dangerous", "secure_recommendation"], fixed.REMEDIATION),
    "dim_fix_example": (["cwe", "lang", "example"], fixed.FIX_EXAMPLES),
    "dim_compliance": (["cwe", "violation"], fixed.COMPLIANCE),
    "dim_payloads": (["cwe", "payload_1", "payload_2", "payload_3"], fixed.PAYLOADS),
    "dim_extension": (["ext", "language"], fixed.EXTENSIONS),
    "kg_nodes": (["node_id", "node_type", "label", "severity"], fixed.KG_NODES),
    "kg_edges": (["src", "dst", "relation"], fixed.KG_EDGES),
}


_LOCAL: WeakKeyDictionary = WeakKeyDictionary()


def dim(spark: SparkSession, name: str) -> DataFrame:
    """The catalogue as a broadcast-hinted local relation, made once per session."""
    made = _LOCAL.setdefault(spark, {})
    if name not in made:
        columns, rows = DIM_ROWS[name]
        table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)})
        made[name] = F.broadcast(spark.createDataFrame(table))
    return made[name]
