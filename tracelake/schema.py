"""Table schemas: repository records as they are stored, and the tables they explode to."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_A = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: What a node says beyond its place: one nullable column for each key, whichever family uses it.
DETAIL = _struct(
    **dict.fromkeys(
        "method path raw subkind pattern snippet symbol receiver parameterised operation client target_repo target_repo_evidence target_repo_confidence purpose host http_method url config_key system topic direction algorithm provider field_name mechanism library_hint enclosing_class enclosing_method self_name channel endpoint_path sink_symbol key vendor bucket source key_source weakest_link".split(),
        _S,
    ),
    **{"class": _S, "import": _S, "from": _S},
    **dict.fromkeys("execution receiver_is_database file_sql_evidence externally_triggered is_interface weak search_truncated".split(), _B),
    **dict.fromkeys("http_out_line start_line end_line field_line sink_line value_line hops".split(), _I),
    **dict.fromkeys("paths client_paths arguments params supertypes tainted_at_sink path_hops resolved_symbols".split(), _A),
    fields=T.MapType(_S, _S),
)
NODE = _struct(id=_S, repo=_S, file=_S, line=_I, language=_S, framework=_S, kind=_S, family=_S, detail=DETAIL, pii_classification=_S, data_class=_S, confidence=_S)
EDGE = _struct(src_id=_S, dst_id=_S, kind=_S, evidence=_S, confidence=_S)
DEPENDENCY = _struct(groupId=_S, artifactId=_S, version=_S, version_kind=_S, kind=_S, resolution=_S)
RECORD = _struct(
    schema_version=_I, detection_version=_I, derivation_version=_I, group=_S, name=_S, path=_S, git_sha=_S, analysed_at=_S, primary_language=_S,
    language_breakdown=T.MapType(_S, _L), build_systems=_A, frameworks=_A, dependencies_internal=T.ArrayType(DEPENDENCY), dependencies_external_count=_L,
    nodes=T.ArrayType(NODE), edges=T.ArrayType(EDGE), file_counts=T.MapType(_S, _L), notes=_A,
)

KINDS = ("source", "propagator", "sink", "store", "reference", "finding")
STAGES = ("collect", "process", "store", "transmit", "log", "encrypt", "delete")
