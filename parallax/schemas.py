"""Fixed table schemas and enumerations; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

#: Enumerations in their reporting order. Fixed values.
CONDITIONS = ("nl_exp7_anchor", "procedural_prose", "controlled_nl", "pseudocode", "python_canonical", "python_opaque")
ANCHOR = CONDITIONS[0]
METRICS = ("h20", "valid_vocab", "semantic_step")
#: contrast, left condition, right condition, alternative. Fixed values.
CONTRASTS = (
    ("C1", "procedural_prose", "controlled_nl", "positive"),
    ("C2", "controlled_nl", "pseudocode", "positive"),
    ("C3", "pseudocode", "python_canonical", "positive"),
    ("C4", "python_opaque", "python_canonical", "two_sided"),
)
#: Statuses of a token's mapping to a step. Fixed values.
MAPPED, BOUNDARY, UNMAPPED = "mapped", "boundary_overlap", "unmapped"
WHITESPACE, PUNCTUATION, NOT_APPLICABLE, FIRST_TOKEN = "whitespace_only", "punctuation_only", "not_applicable", "excluded_first_token"

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


TASK = _struct(id=_S, family=_S, task=_S, nl=T.ArrayType(_S), python=T.ArrayType(_S))
SPAN = _struct(semantic_step_id=_S, start_char=_I, end_char=_I)
TRACE_NODE = _struct(trace_node_id=_S, node_type=_S, path_key=_S, owner_semantic_step_id=_S)
STEP = _struct(semantic_step_id=_S, kind=_S, path_key=_S, trace_node_id=_S)
PROGRAM = _struct(
    program_id=_S, task_id=_S, family=_S, variant=_I, task_text=_S, source_python=_S, source_nl=_S, function_name=_S, parameters=T.ArrayType(_S),
    statement_count=_I, ast=_S, trace_nodes=T.ArrayType(TRACE_NODE), semantic_steps=T.ArrayType(STEP),
)
OPACITY = _struct(
    mapping=T.ArrayType(_struct(original=_S, opaque=_S)), canonical_function_name=_S, opaque_function_name=_S,
    canonical_locals=T.ArrayType(_S), opaque_locals=T.ArrayType(_S), canonical_globals=T.ArrayType(_S), opaque_globals=T.ArrayType(_S),
)
RENDERED = _struct(
    trajectory_id=_S, program_id=_S, task_id=_S, family=_S, variant=_I, condition=_S, task_text=_S, reference_text=_S, source_python=_S,
    trace_spans=T.ArrayType(_struct(trace_node_id=_S, start_char=_I, end_char=_I)), semantic_step_spans=T.ArrayType(SPAN), opacity=OPACITY,
)
TOKEN = _struct(
    trajectory_id=_S, program_id=_S, task_id=_S, family=_S, variant=_I, condition=_S, reference_position=_I, absolute_token_position=_I,
    reference_token_id=_I, reference_token=_S, reference_char_start=_I, reference_char_end=_I, entropy_top20_normalized=_D, entropy_valid_vocab=_D,
    p1=_D, p2=_D, top20_mass=_D, reference_logprob=_D, reference_surprisal=_D, reference_rank=_I, reference_in_top20=_B,
    semantic_mapping_status=_S, semantic_step_id=_S, top20_json=_S,
)
TRAJECTORY = _struct(trajectory_id=_S, task_id=_S, family=_S, condition=_S, variant=_I, trajectory_valid=_B, mean_entropy_top20=_D, mean_entropy_valid_vocab=_D, semantic_step_balanced_entropy_top20=_D, step_mapped_token_fraction=_D)
TASK_DELTA = _struct(task_id=_S, family=_S, delta=_D)
FAMILY_CONTRAST = _struct(contrast=_S, left_condition=_S, right_condition=_S, family=_S, delta_h20=_D, delta_valid_vocab=_D, delta_semantic_step=_D)
REGISTRY = _struct(slug=_S, model_id=_S, revision=_S, revision_source=_S, c4_equivalence_margin=_D)
MANIFEST = _struct(path=_S, size_bytes=_L, sha256=_S)
