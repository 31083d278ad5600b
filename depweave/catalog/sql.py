"""The workspace view in SQL: what the oracles of all queries begin with."""

from __future__ import annotations

FACTS = """
projects AS (SELECT 'name:' || n_name AS project_key, n_name AS name, n_nationkey FROM nation),
docs AS (
  SELECT 'document:c' || c_custkey AS document_id, c_name AS name, 'name:' || n_name AS project_key FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'document:s' || s_suppkey, s_name, 'name:' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
decl AS (
  SELECT 'o' || o_orderkey AS symbol_key, 'symbol:o' || o_orderkey AS symbol_id, 'document:c' || o_custkey AS document_id, o_orderkey AS ordinal FROM orders
  UNION ALL SELECT DISTINCT 'p' || l_partkey, 'symbol:p' || l_partkey, 'document:s' || l_suppkey, l_suppkey FROM lineitem),
syms AS (
  SELECT 'symbol:o' || o_orderkey AS symbol_id, 'document:c' || o_custkey AS document_id, o_orderpriority AS kind, 'Order' || o_orderkey AS name, CAST(o_orderkey % 500 + 1 AS INTEGER) AS line FROM orders
  UNION ALL SELECT 'symbol:p' || p_partkey, 'document:s' || s, p_type, p_name, CAST(p_partkey % 500 + 1 AS INTEGER) FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey),
obs AS (
  SELECT l_orderkey * 10 + l_linenumber AS ordinal, 'document:c' || o_custkey AS sdoc, 'symbol:o' || l_orderkey AS ssym, 'p' || l_partkey AS tkey, 'symbol:p' || l_partkey AS tsym, 'o' || l_orderkey AS skey,
         CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'creation' ELSE 'reference' END AS kind, CASE l_linestatus WHEN 'O' THEN 'high' ELSE 'medium' END AS conf,
         CASE WHEN l_quantity >= 10 THEN 'c' || o_custkey || '.cs' END AS file, CASE WHEN l_quantity >= 10 THEN l_linenumber END AS line, CASE WHEN l_quantity >= 10 THEN 'use p' || l_partkey END AS snippet
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
doc_pairs AS (SELECT obs.*, d.document_id AS tdoc FROM obs JOIN (SELECT DISTINCT symbol_key, document_id FROM decl) d ON d.symbol_key = obs.tkey WHERE d.document_id <> sdoc),
doc_edges AS (
  SELECT sdoc AS source, tdoc AS target, count(*) AS reference_count, arg_min(file, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL) AS sample_file, arg_min(line, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL) AS sample_line,
         arg_min(snippet, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL) AS sample_snippet FROM doc_pairs GROUP BY ALL),
sym_edges AS (
  SELECT ssym AS source, tsym AS target, kind AS reference_kind, conf AS confidence, count(*) AS reference_count, arg_min(file, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL) AS sample_file,
         arg_min(line, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL) AS sample_line, arg_min(snippet, {'o': ordinal, 's': snippet}) FILTER (file IS NOT NULL) AS sample_snippet FROM obs GROUP BY ALL),
ref_counts AS (
  SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
refs AS (
  SELECT 'name:' || x.n_name AS source, 'name:' || y.n_name AS target, weight
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS n FROM ref_counts) JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE n <= 2),
ext AS (
  SELECT DISTINCT 'name:' || n_name AS project_key, p_brand AS brand, p_type AS type FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def node(prefix: str, x: str) -> str:
    """The id of a node whose identity is the expression x (ASCII)."""
    return f"'{prefix}:' || lower(regexp_replace({x}, '[^A-Za-z0-9]', '_', 'g')) || '_' || substr(sha256({x}), 1, 8)"


#: Mutual reach of projects: a node and the least node of its cycle.
CYCLES = """
reach AS (SELECT source, target FROM refs UNION SELECT r.source, e.target FROM reach r JOIN refs e ON r.target = e.source),
members AS (
  SELECT a.source AS node, least(a.source, min(a.target)) AS component FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source GROUP BY a.source)
"""

GRAPH = f"""
kind_edges AS (
  SELECT {node('project', 'project_key')} AS source, document_id AS target, 'contains-document' AS kind, 1 AS weight, CAST(NULL AS VARCHAR) AS rk, CAST(NULL AS VARCHAR) AS cf FROM docs
  UNION ALL SELECT document_id, symbol_id, 'contains-symbol', 1, NULL, NULL FROM syms
  UNION ALL SELECT DISTINCT {node('project', 'project_key')}, {node('package', 'brand')}, 'project-package', 1, NULL, NULL FROM ext
  UNION ALL SELECT DISTINCT {node('project', 'project_key')}, {node('assembly', 'type')}, 'project-assembly', 1, NULL, NULL FROM ext
  UNION ALL SELECT {node('project', 'source')}, {node('project', 'target')}, 'project-reference', 1, NULL, NULL FROM refs
  UNION ALL SELECT source, target, 'document-reference', reference_count, NULL, NULL FROM doc_edges
  UNION ALL SELECT source, target, CASE WHEN reference_kind IN ('call', 'creation') THEN 'symbol-' || reference_kind ELSE 'symbol-reference' END, reference_count, reference_kind, confidence FROM sym_edges),
all_nodes AS (
  SELECT {node('project', 'project_key')} AS id, name AS label, 'project' AS grp, CAST(NULL AS VARCHAR) AS symbol_kind FROM projects
  UNION ALL SELECT document_id, name, 'document', NULL FROM docs
  UNION ALL SELECT symbol_id, name, 'symbol', kind FROM syms
  UNION ALL SELECT DISTINCT {node('package', 'brand')}, brand, 'package', NULL FROM ext
  UNION ALL SELECT DISTINCT {node('assembly', 'type')}, type, 'assembly', NULL FROM ext)
"""


def facts(query: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([FACTS, *more])} {query.lstrip()}"
