"""The canonical tables as views over the driver's tables, in SQL that Spark and DuckDB both run.

The driver has no program facts, so parts play symbols, consecutive order lines calls between
them, and documents declarations with their texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: View: its SQL; other views and tables in braces.
VIEWS = {
    "symbols": """SELECT p_partkey AS id, 1 AS analysis_profile_id, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 7 = 1 THEN 3 ELSE 2 END AS kind, p_name AS name,
        REPLACE(p_brand, '#', '') AS namespace_name, REPLACE(p_type, ' ', '.') AS type_identity_path, REPLACE(p_type, ' ', '.') AS type_display_path,
        REPLACE(p_name, ' ', '_') AS executable_identity_path, REPLACE(p_name, ' ', '_') AS executable_display_path, CONCAT('k', CAST(p_partkey AS VARCHAR(20))) AS stable_key,
        CASE WHEN p_size = 1 THEN 5 WHEN p_size = 2 THEN 2 ELSE 0 END AS async_role,
        CASE WHEN p_partkey > 1 THEN CAST(FLOOR(p_partkey / 2.0) AS BIGINT) END AS containing_symbol_id,
        CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 500 END AS preferred_declaration_id,
        CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 7 ELSE 2 END END AS type_kind,
        CAST(p_size % 7 AS INT) AS accessibility FROM {part}""",
    "calls": """SELECT x.l_partkey * 10000000 + y.l_partkey AS id, 1 AS analysis_profile_id, x.l_partkey AS caller_symbol_id, y.l_partkey AS callee_definition_id, y.l_partkey AS callee_symbol_id,
        MIN(x.l_orderkey) AS document_id, MIN(x.l_linenumber) AS source_start, CAST(MAX(x.l_quantity) AS INT) AS source_length,
        CASE WHEN MIN(x.l_linestatus) = 'O' THEN 2 ELSE 1 END AS reference_kind, 1 AS dispatch_kind, 1 AS resolution_status, 0 AS resolution_reason,
        CAST(MIN(x.l_linenumber) % 7 AS INT) AS async_usage_kind, MAX(x.l_returnflag) = 'R' AS is_generated
        FROM {lineitem} x JOIN {lineitem} y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
        WHERE x.l_quantity >= 45 AND x.l_partkey <> y.l_partkey GROUP BY x.l_partkey, y.l_partkey""",
    "call_candidates": "SELECT id AS call_id, caller_symbol_id + 1 AS candidate_symbol_id FROM {calls} WHERE source_start = 2",
    "symbol_relations": """SELECT 1 AS analysis_profile_id, p_partkey AS source_symbol_id, CAST(FLOOR(p_partkey / 3.0) AS BIGINT) AS target_symbol_id, CAST(1 + p_partkey % 5 AS INT) AS relation_kind FROM {part} WHERE p_partkey >= 3
        UNION ALL SELECT 1, p_partkey, p_partkey + 1, 1 FROM {part} WHERE p_partkey % 50 = 0 UNION ALL SELECT 1, p_partkey, p_partkey - 1, 1 FROM {part} WHERE p_partkey % 50 = 1 AND p_partkey > 1""",
    "interface_method_bindings": "SELECT 1 AS analysis_profile_id, p_partkey AS implementing_type_id, p_partkey % 10 AS interface_method_id, p_partkey + 1 AS implementation_method_id FROM {part} WHERE p_partkey % 2 = 0",
    "declarations": """SELECT doc_id AS id, CONCAT('d', CAST(doc_id AS VARCHAR(20))) AS declaration_key, doc_id % 100 + 1 AS symbol_id, doc_id AS document_id, source AS document_key,
        CAST(doc_id % 3 + 1 AS INT) AS declaration_role, CAST(n_chars % 97 AS INT) AS source_start, 10 AS source_length, lang = 'fr' AS is_generated FROM {documents}""",
    "files": "SELECT doc_id AS id, CONCAT(source, '/', lang, '/', CAST(doc_id AS VARCHAR(20)), '.cs') AS normalized_path, text AS source_text, lang = 'fr' AS is_generated, doc_id % 20 AS project_id FROM {documents}",
    # For the query service: symbols with generic types and parameter lists, declarations of their own, and calls of all order lines.
    "code_symbols": """SELECT p_partkey AS id, 1 AS analysis_profile_id, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 7 = 1 THEN 3 ELSE 2 END AS kind, REPLACE(p_name, ' ', '_') AS name,
        CASE WHEN p_size % 11 = 0 THEN 'System.IO' ELSE CONCAT('Ns', CAST(p_size % 7 AS VARCHAR(2))) END AS namespace_name,
        CONCAT(REPLACE(p_brand, '#', ''), CASE WHEN p_size % 4 = 0 THEN '<T>' WHEN p_size % 4 = 1 THEN '.Inner<A,B>' ELSE '' END) AS type_identity_path,
        CONCAT(REPLACE(p_brand, '#', ''), CASE WHEN p_size % 4 = 0 THEN '<T>' WHEN p_size % 4 = 1 THEN '.Inner<A,B>' ELSE '' END) AS type_display_path,
        CONCAT(REPLACE(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '()' WHEN 1 THEN '(System.Int32)' WHEN 2 THEN '<T>(System.Int32)' ELSE '(System.String,System.Int32)' END) AS executable_identity_path,
        CONCAT(REPLACE(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '()' WHEN 1 THEN '(int)' WHEN 2 THEN '<T>(int)' ELSE '(string, int)' END) AS executable_display_path,
        CONCAT('k', CAST(p_partkey AS VARCHAR(20))) AS stable_key, CASE WHEN p_size = 1 THEN 5 WHEN p_size = 2 THEN 2 ELSE 0 END AS async_role,
        CASE WHEN p_partkey > 1 THEN CAST(FLOOR(p_partkey / 2.0) AS BIGINT) END AS containing_symbol_id, CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS preferred_declaration_id,
        CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 7 ELSE 2 END END AS type_kind FROM {part}""",
    "code_declarations": """SELECT doc_id AS id, CONCAT('d', CAST(doc_id AS VARCHAR(20))) AS declaration_key, doc_id AS symbol_id, doc_id AS document_id, CAST(doc_id % 3 + 1 AS INT) AS declaration_role,
        CAST(n_chars % 97 AS INT) AS source_start, 10 AS source_length, lang = 'fr' AS is_generated FROM {documents}""",
    "code_calls": """SELECT x.l_partkey * 10000000 + y.l_partkey AS id, 1 AS analysis_profile_id, x.l_partkey AS caller_symbol_id, y.l_partkey AS callee_definition_id, y.l_partkey AS callee_symbol_id,
        MIN(x.l_orderkey) % 100 AS document_id, CAST(MIN(x.l_linenumber) AS INT) AS source_start, CAST(MAX(x.l_quantity) AS INT) AS source_length,
        CASE WHEN MIN(x.l_linestatus) = 'O' THEN 3 ELSE 1 END AS reference_kind, 1 AS dispatch_kind, 1 AS resolution_status, 0 AS resolution_reason,
        CAST(MIN(x.l_linenumber) % 7 AS INT) AS async_usage_kind, CAST(NULL AS VARCHAR(10)) AS unresolved_name
        FROM {lineitem} x JOIN {lineitem} y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.l_partkey <> y.l_partkey GROUP BY x.l_partkey, y.l_partkey""",
    "code_candidates": "SELECT id AS call_id, CASE WHEN caller_symbol_id > 9 THEN caller_symbol_id - 7 ELSE caller_symbol_id END AS candidate_symbol_id FROM {code_calls} WHERE source_start = 2",
    "conditional_symbols_used": "SELECT 1 AS analysis_profile_id, user_id AS document_id, event_type AS symbol_name, COUNT(*) AS occurrence_count FROM {events} GROUP BY user_id, event_type",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Views:
    """The views, and the driver's tables, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                self._made[name] = self.spark.sql(sql, **{n: getattr(self, n) for n in _names(sql)})
            elif name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})


def for_oracle(body: str) -> str:
    """body, whose views stand in braces, with these as common table expressions. `{with}` in body: where more of them follow."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for n in _names(sql):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(body)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    views = [f"{n} AS ({plain(VIEWS[n])})" for n in needed]
    more, _, main = body.partition("MAIN") if "MAIN" in body else ("", "", body)
    parts = [*views, *([plain(more.strip().rstrip(","))] if more.strip() else [])]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + plain(main)
