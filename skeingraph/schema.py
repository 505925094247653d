"""The data model: table schemas and enumeration codes. Values are fixed by the stored format."""

from __future__ import annotations

from enum import IntEnum, IntFlag

from pyspark.sql import types as T

SCHEMA_VERSION = 6


class AsyncRole(IntFlag):
    NONE = 0
    DECLARED_ASYNC = 1
    RETURNS_AWAITABLE = 2
    CONTAINS_AWAIT = 4
    ASYNC_ITERATOR = 8
    RETURNS_ASYNC_ENUMERABLE = 16
    ASYNC_VOID = 32
    UNITASK_VOID = 64
    USES_AWAIT_FOREACH = 128
    USES_AWAIT_USING = 256


class InputMode(IntEnum):
    SOLUTION, PROJECT, DIRECTORY = range(1, 4)


class GenerationKind(IntEnum):
    NONE, FILE_NAME, AUTO_GENERATED_HEADER, GENERATED_DIRECTORY, ASSEMBLY_ATTRIBUTES = range(5)


class SegmentKind(IntEnum):
    NAMED, SPECIAL, LAMBDA, ANONYMOUS_METHOD, INITIALIZER, TOP_LEVEL_STATEMENTS = range(1, 7)


class TypeKind(IntEnum):
    UNKNOWN, ARRAY, CLASS, DELEGATE, DYNAMIC, ENUM, ERROR, INTERFACE, MODULE, POINTER, STRUCT, TYPE_PARAMETER, SUBMISSION, FUNCTION_POINTER, EXTENSION = range(15)


class Accessibility(IntEnum):
    NOT_APPLICABLE, PRIVATE, PROTECTED_AND_INTERNAL, PROTECTED, INTERNAL, PROTECTED_OR_INTERNAL, PUBLIC = range(7)


class ResolutionReason(IntEnum):
    NONE, MISSING_METADATA_REFERENCE, COMPILATION_ERROR, AMBIGUOUS_CANDIDATES, DYNAMIC_DISPATCH, UNSUPPORTED_CONSTRUCT, UNKNOWN = range(7)


class AsyncStatus(IntEnum):
    ALL, ASYNC, SYNC = range(3)


class AsyncUsage(IntEnum):
    NONE, AWAITED, FORWARDED, STORED, PASSED, DISCARDED, UNOBSERVED = range(7)


class SymbolKind(IntEnum):
    TYPE, METHOD, LAMBDA, INITIALIZER, TOP_LEVEL_STATEMENTS = range(1, 6)


class DeclarationRole(IntEnum):
    ORDINARY, PARTIAL_DEFINITION, PARTIAL_IMPLEMENTATION = range(1, 4)


class ReferenceKind(IntEnum):
    INVOCATION, OBJECT_CREATION, METHOD_GROUP, DELEGATE_CREATION, NAME_OF, OPERATOR, CONVERSION, DYNAMIC_INVOCATION, UNKNOWN = range(1, 10)


class DispatchKind(IntEnum):
    STATIC, VIRTUAL, INTERFACE, DYNAMIC = range(1, 5)


class ResolutionStatus(IntEnum):
    RESOLVED, AMBIGUOUS, UNRESOLVED, DYNAMIC = range(1, 5)


class RelationKind(IntEnum):
    INHERITS, IMPLEMENTS, OVERRIDES, EXPLICITLY_IMPLEMENTS, IMPLICITLY_IMPLEMENTS, PARTIAL_DEFINITION, PARTIAL_IMPLEMENTATION = range(1, 8)


class CallerScope(IntEnum):
    DIRECT, CONTAINING, BOTH = range(1, 4)


class GeneratedFilter(IntEnum):
    INCLUDE, EXCLUDE, ONLY = range(3)


class DispatchSearch(IntEnum):
    STATIC, VIRTUAL, ALL = range(1, 4)


EXECUTABLE = (SymbolKind.METHOD, SymbolKind.LAMBDA, SymbolKind.INITIALIZER, SymbolKind.TOP_LEVEL_STATEMENTS)
CALL_KINDS = (ReferenceKind.INVOCATION, ReferenceKind.OBJECT_CREATION)

#: Columns of every table, key first; "!" marks those that may not be null.
_COLUMNS = {
    "schema_info": "version int!",
    "analysis_profiles": "id long!, name string!, input_mode int!, configuration string, target_framework string, runtime_identifier string, operating_system string!, architecture string!, preprocessor_symbols array<string>!, profile_hash binary!",
    "index_runs": "id long!, analysis_profile_id long!, input_root string!, index_root_anchor string!, input_fingerprint binary!, request_hash binary!, indexed_at_utc timestamp!",
    "projects": "id long!, index_run_id long!, analysis_profile_id long!, name string!, assembly_name string, project_path string, target_framework string, project_fingerprint binary!",
    "normalized_sources": "id long!, normalized_source_hash binary!, normalized_source string!",
    "documents": "id long!, project_id long!, normalized_path string!, content_hash binary!, semantic_hash binary, normalized_source_id long!, is_generated boolean!, generation_kind int!",
    "symbols": "id long!, analysis_profile_id long!, project_id long, stable_key string!, kind int!, name string!, namespace_name string!, type_simple_name string, type_metadata_name string, path_segment_kind int!, path_segment_display string!, path_segment_identity string!, type_display_path string!, type_identity_path string!, executable_display_path string!, executable_identity_path string!, preferred_declaration_id long, containing_symbol_id long, arity int!, parameter_count int, method_kind int, accessibility int, type_kind int, is_static boolean!, is_abstract boolean!, is_virtual boolean!, is_override boolean!, async_role int!, async_involvement_depth int, return_type_key string, return_type_display string, conversion_type_key string, conversion_type_display string, async_next_symbol_id long, is_generated boolean!",
    "method_parameters": "method_id long!, ordinal int!, name string, type_key string!, type_display string!, ref_kind int!, is_optional boolean!",
    "symbol_declarations": "id long!, declaration_key string!, symbol_id long!, document_id long!, declaration_role int!, source_start int!, source_length int!, normalized_start int!, normalized_length int!, is_generated boolean!",
    "calls": "id long!, analysis_profile_id long!, caller_symbol_id long!, callee_symbol_id long, callee_definition_id long, reference_kind int!, dispatch_kind int!, resolution_status int!, resolution_reason int!, async_usage_kind int!, document_id long!, source_start int!, source_length int!, normalized_start int!, normalized_length int!, unresolved_name string, receiver_type_key string",
    "call_candidates": "call_id long!, candidate_symbol_id long!",
    "symbol_relations": "analysis_profile_id long!, source_symbol_id long!, target_symbol_id long!, relation_kind int!",
    "interface_method_bindings": "analysis_profile_id long!, implementing_type_id long!, interface_method_id long!, implementation_method_id long!",
    "conditional_symbols_used": "analysis_profile_id long!, document_id long!, symbol_name string!, occurrence_count int!",
}

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    pairs = (column.split(" ") for column in text.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind.removesuffix("!")], not kind.endswith("!")) for name, kind in pairs])


SCHEMAS: dict[str, T.StructType] = {name: _schema(text) for name, text in _COLUMNS.items()}
