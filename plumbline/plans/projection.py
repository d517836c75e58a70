"""Identities of page documents: of all that was given, and of the content without what is added after building."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import Tables
from ..operators.fold import rebuilt
from ..sources.documents import json_nodes

#: What building adds to a document, as paths.
ADDED_LATER = [
    r"\$\.(delivery_status|runtime_preflight|visual_gate|editability_gate)",
    r"\$\.modules\.high_risk",
    r"\$\.modules\.typography\.items\[[0-9]+\]\.font_declaration_verified",
    r"\$\.modules\.icons\.icons\[[0-9]+\]\.selectable_picture_verified",
]
#: A module that is added later is no longer named among the activated ones.
LATE_MODULE = "high_risk"


def identities(texts: DataFrame, *, id_col: str = "doc_id", text_col: str = "raw") -> DataFrame:
    """(doc_id, input_sha256, content_sha256) of JSON documents; null for texts that are no finite JSON objects.

    Both are digests of canonical JSON, the second without what is added later.  Texts are parsed once.
    """
    tables = Tables(texts.sparkSession)
    nodes = json_nodes(texts, id_col=id_col, text_col=text_col)
    late = F.col("path").rlike("^(?:" + "|".join(ADDED_LATER) + r")\z") | (F.col("path").rlike(r"^\$\.activated_modules\[[0-9]+\]\z") & (F.col("text") == f'"{LATE_MODULE}"'))
    # a record's root says what the text is; texts without one have a row of their own, and no digests
    both = tables.put(rebuilt(nodes, drop=late, whole=True))
    record = F.col("whole").startswith("{")
    digest = lambda c: F.when(record, F.sha2(c, 256))
    known = both.select("doc_id", digest("whole").alias("input_sha256"), digest("text").alias("content_sha256"))
    out = tables.put(texts.select(F.col(id_col).alias("doc_id")).distinct().join(known, "doc_id", "left").select("doc_id", "input_sha256", "content_sha256"))
    tables.drop(both)
    return out
