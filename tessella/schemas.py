"""The unified chat and tool-calling schema. JSON of open shape (arguments, tool definitions) stays a string."""

from __future__ import annotations

CALL = "struct<name: string, arguments: string>"
MESSAGE = f"struct<role: string, content: string, tool_calls: array<{CALL}>, name: string>"
SAMPLE = f"sample_id bigint, source string, messages array<{MESSAGE}>, tools array<string>"
EXPECT = f"struct<mode: string, calls: array<{CALL}>>"
CASE = f"id string, category string, messages array<{MESSAGE}>, tools array<string>, expect {EXPECT}, benchmark_source string"
PARSED = "struct<calls: array<struct<name: string, arguments: string, valid_json: boolean, raw: string, source: string>>, invalid_blocks: array<string>>"
SCORE = (
    "struct<expected_tool: boolean, expected_names: array<string>, predicted_names: array<string>, valid_format: boolean, canonical_format: boolean, "
    "tool_selection_correct: boolean, arg_key_accuracy: double, arg_exact_match: boolean, no_tool_correct: boolean, clean_stop: boolean, invalid_json: boolean, "
    "wrong_tool: boolean, missing_argument: boolean, extra_argument: boolean, overall: boolean, strict_protocol_success: boolean>"
)
