"""Declared schemas and closed domains."""

from __future__ import annotations

from pyspark.sql import types as T

# The closed domains of the data model.
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
PURPOSES = ["ingest", "plan", "read", "answer"]
REQUIRED_NODE_FIELDS = ["file_type", "id", "label", "source_file"]
REQUIRED_EDGE_FIELDS = ["confidence", "relation", "source", "source_file", "target"]

NODE_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_location", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("summary", T.StringType()),
]
EDGE_FIELDS = [
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("relation", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_location", T.StringType()),
    T.StructField("weight", T.DoubleType()),
]
PROVENANCE = [
    T.StructField("fragment_key", T.StringType()),
    T.StructField("pos", T.LongType()),
]

NODE = T.StructType(NODE_FIELDS)
EDGE = T.StructType(EDGE_FIELDS)
NODE_RECORD = T.StructType(NODE_FIELDS + PROVENANCE)
EDGE_RECORD = T.StructType(EDGE_FIELDS + PROVENANCE)
RAW_CALL = T.StructType(
    [
        T.StructField("caller", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
    + PROVENANCE
)
DEFINITION = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("node_id", T.StringType())] + PROVENANCE
)
CODE_LINK = T.StructType(
    [T.StructField("concept_id", T.StringType()), T.StructField("code_name", T.StringType())] + PROVENANCE
)
LEDGER = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("purpose", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("wall_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("superseded", T.BooleanType()),
    ]
)
