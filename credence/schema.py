"""Explicit schemas of the tables that the operators exchange; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TURNS = _struct(item_id=_S, turn_id=_L, recv_index=_L, role=_S, content=_S, date=_S, has_answer=_B)
SEARCH_ITEM = _struct(rank=_L, title=_S, url=_S, snippet=_S, source_type=_S)
NODES = _struct(
    item_id=_S, id=_L, node_type=_S, text=_S, stance=_S, role=_S, source_type=_S, entities=T.ArrayType(_S), turn_id=_L, evidence_ids=T.ArrayType(_L), initial_evidence_count=_L,
    extraction_method=_S, tool_name=_S, query=_S, tool_arguments=_S, tool_call_id=_S, tool_result_items=T.ArrayType(SEARCH_ITEM), merged_from=T.ArrayType(_L), initial_confidence=_D, evidence_confidence=_D,
    factor_confidence=_D, confidence=_D, active=_B,
)
EVIDENCE = _struct(item_id=_S, id=_L, text=_S, start=_L, end=_L, match=_S, via=_S, stance=_S, role=_S, source_type=_S, turn_id=_L)
RELATIONS = _struct(item_id=_S, id=_L, from_id=_L, to_id=_L, type=_S, note=_S, weight=_D, threshold=_D)
USAGE = _struct(label=_S, model=_S, input_tokens=_L, output_tokens=_L, total_tokens=_L, reasoning_tokens=_L, cost=_D)
TASKS = _struct(task_id=_S, benchmark=_S, question=_S, answers=T.ArrayType(_S), metadata=T.MapType(_S, _S))
WIRE_TURN = _struct(problem_id=_S, role=_S, content=_S, is_message_end=_B, is_trajectory_end=_B, date=_S, session_date=_S, has_answer=_B)

#: Values that enumerated columns may hold.
STANCES = ("asserted", "recalled", "judged", "speculated")
RELATION_TYPES = ("depends_on", "supplements", "contradicts")
ROLES = ("user", "assistant", "tool")
