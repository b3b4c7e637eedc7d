"""DuckDB SQL twins of ``spotframe.sources.adapter`` (common table expressions).

``with_views(body)`` prefixes a query with the adapter CTEs so every oracle
string runs directly on the driver's pre-registered parquet views.
"""

from __future__ import annotations

ADAPTER_CTES = {
    "spots": """
  SELECT 'S' || CAST(c_custkey % 6 AS VARCHAR) AS sample,
         CAST(c_custkey AS VARCHAR) AS barcode,
         CAST(1 AS INTEGER) AS in_tissue,
         CAST((c_custkey // 6) // 10 AS INTEGER) AS array_row,
         CAST(2 * ((c_custkey // 6) % 10) + ((c_custkey // 6) // 10) % 2 AS INTEGER) AS array_col,
         50.0::DOUBLE * CAST(2 * ((c_custkey // 6) % 10) + ((c_custkey // 6) // 10) % 2 AS DOUBLE) AS x,
         86.6::DOUBLE * CAST((c_custkey // 6) // 10 AS DOUBLE) AS y,
         c_mktsegment AS cluster,
         CASE WHEN c_custkey % 6 < 3 THEN 'C' ELSE 'P' END AS condition
  FROM customer""",
    "expr": """
  SELECT 'S' || CAST(o_custkey % 6 AS VARCHAR) AS sample, CAST(o_custkey AS VARCHAR) AS barcode,
         CAST(l_partkey AS VARCHAR) AS gene, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3 HAVING sum(l_quantity) <> 0""",
    "expr_coarse": """
  SELECT 'S' || CAST(o_custkey % 6 AS VARCHAR) AS sample, CAST(o_custkey AS VARCHAR) AS barcode,
         p_name AS gene, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2, 3 HAVING sum(l_quantity) <> 0""",
    "genes": """
  SELECT CAST(p_partkey AS VARCHAR) AS gene_id, p_name AS gene_name, CAST(p_partkey AS BIGINT) AS idx
  FROM part""",
    "composition": """
  SELECT sample, barcode, cell_type, v / sum(v) OVER (PARTITION BY sample, barcode) AS score
  FROM (SELECT 'S' || CAST(o_custkey % 6 AS VARCHAR) AS sample, CAST(o_custkey AS VARCHAR) AS barcode,
               p_type AS cell_type, sum(l_quantity) AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2, 3) t""",
    "lr_db": """
  SELECT array_to_string(ligand, '+') || '_' || array_to_string(receptor, '+') AS lr, ligand, receptor, pathway
  FROM (SELECT [l.name] AS ligand,
               CASE WHEN r.name = 'hot ring' THEN [r.name, 'hot bolt'] ELSE [r.name] END AS receptor,
               l.noun AS pathway
        FROM (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part) l
        JOIN (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj FROM part) r
          ON l.adj = 'cold' AND r.adj = 'hot') t""",
    "lr_db_all": """
  SELECT array_to_string(ligand, '+') || '_' || array_to_string(receptor, '+') AS lr, ligand, receptor, pathway
  FROM (SELECT [l.name] AS ligand,
               CASE WHEN r.name = 'hot ring' THEN [r.name, 'hot bolt'] ELSE [r.name] END AS receptor,
               l.noun AS pathway
        FROM (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part) l
        JOIN (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 1) AS adj FROM part) r
          ON (l.adj = 'cold' AND r.adj = 'hot') OR (l.adj = 'blue' AND r.adj = 'red')) t""",
    "embedding": """
  SELECT 'B' || CAST(vec_id % 2 AS VARCHAR) AS sample, CAST(vec_id AS VARCHAR) AS barcode,
         CAST(embedding AS DOUBLE[]) AS vec, 'L' || CAST(label AS VARCHAR) AS label
  FROM embeddings""",
}


def with_views(body: str, views: list[str] | None = None) -> str:
    """Prefix ``body`` (``name AS (...), ... SELECT ...`` or plain ``SELECT``) with adapter CTEs."""
    names = views if views is not None else list(ADAPTER_CTES)
    ctes = ",\n".join(f"{n} AS ({ADAPTER_CTES[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("SELECT") or body.upper().startswith("("):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes},\n{body}"
