"""Registered core queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import hierarchy, intervals
from palimpsest.plans import knowledge, queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": intervals.found,
    "p1_coverage": intervals.coverage,
    "p3_found": hierarchy.found,
    "p3_paths": hierarchy.paths,
    "p3_descendants": hierarchy.descendant_intervals,
    "p3_lineage": hierarchy.newest_lineage,
    "p3_successors": hierarchy.key_successors,
    **queries.QUERIES,
    **knowledge.QUERIES,
}

_DAYS = f"""
  x AS (SELECT 'source_documents' AS entity_table, source_key AS entity_key, {queries._start_sql('effective_from')} AS s, {queries._end_sql('effective_to')} AS e FROM source_documents WHERE source_key IS NOT NULL
    UNION ALL SELECT 'evidence_relations', subject_document_id || '|' || lower(trim(predicate, ' \t\n\r')) || '|' || object_document_id, {queries._start_sql('valid_from')}, {queries._end_sql('valid_to')} FROM evidence_relations WHERE object_document_id IS NOT NULL),
  n AS (SELECT *, max(e) OVER (PARTITION BY entity_table, entity_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x WHERE s < e),
  r AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY entity_table, entity_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM n),
  p AS (SELECT entity_table, entity_key, min(s) AS s, max(e) AS e FROM r GROUP BY entity_table, entity_key, run)"""

_LINKS = """
  rec AS (SELECT source_id AS id, previous_source_id AS link FROM source_lifecycle WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY recorded_at DESC NULLS LAST, previous_source_id DESC NULLS LAST) = 1),
  names AS (SELECT lower(regexp_replace(id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS name, min(id) AS id FROM rec GROUP BY 1),
  link AS (SELECT rec.id, names.id AS parent FROM rec LEFT JOIN names ON names.name = lower(regexp_replace(rec.link, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AND names.name <> '')"""

# The forest of the links walked down from its roots, with subtree sizes, heavy children and the chains they make.
_CHAINS = f"""{_LINKS},
  up AS (SELECT id, id AS node FROM link UNION SELECT up.id, link.parent FROM up JOIN link ON link.id = up.node WHERE link.parent IS NOT NULL),
  size AS (SELECT node AS id, count(*) AS n FROM up GROUP BY node),
  heavy AS (SELECT arg_max(id, (n, id)) AS id FROM link JOIN size USING (id) WHERE parent IS NOT NULL GROUP BY parent),
  child AS (SELECT link.id, parent, id IN (SELECT id FROM heavy) AS along FROM link WHERE parent IS NOT NULL),
  walk AS (SELECT id, id AS chain_id, 0 AS chain_pos, CAST([] AS STRUCT(chain VARCHAR, upto INT)[]) AS above FROM link WHERE parent IS NULL
    UNION ALL SELECT c.id, CASE WHEN along THEN w.chain_id ELSE c.id END, CASE WHEN along THEN w.chain_pos + 1 ELSE 0 END, CASE WHEN along THEN w.above ELSE list_append(w.above, {{'chain': w.chain_id, 'upto': w.chain_pos}}) END FROM walk w JOIN child c ON c.parent = w.id)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_DAYS}, g AS (SELECT entity_table, entity_key, 'gap' AS kind, e AS s, lead(s) OVER (PARTITION BY entity_table, entity_key ORDER BY s) AS e FROM p)
      SELECT entity_table, entity_key, kind, strftime(s, '%Y-%m-%d') AS start_on, strftime(e, '%Y-%m-%d') AS end_on FROM (SELECT entity_table, entity_key, 'period' AS kind, s, e FROM p UNION ALL SELECT * FROM g WHERE e IS NOT NULL)""",
    "p1_coverage": f"""WITH {_DAYS} SELECT entity_table, entity_key, count(*) AS periods, CAST(sum(e - s) AS BIGINT) AS days_covered, CAST(max(e) - min(s) - sum(e - s) AS BIGINT) AS days_in_gaps FROM p GROUP BY ALL""",
    "p3_found": f"""WITH RECURSIVE {_LINKS},
      walk AS (SELECT id, id AS root_id, 0 AS node_depth FROM link WHERE parent IS NULL UNION ALL SELECT link.id, walk.root_id, walk.node_depth + 1 FROM walk JOIN link ON link.parent = walk.id),
      lost AS (SELECT id, parent FROM link WHERE id NOT IN (SELECT id FROM walk)),
      reach AS (SELECT id, parent AS at FROM lost UNION SELECT reach.id, lost.parent FROM reach JOIN lost ON lost.id = reach.at)
      SELECT id AS source_id, root_id, CAST(node_depth AS INT) AS node_depth, 0 AS on_cycle FROM walk
      UNION ALL SELECT id, '', -1, CAST(EXISTS (SELECT 1 FROM reach WHERE reach.id = lost.id AND reach.at = lost.id) AS INT) FROM lost""",
    "p3_paths": f"""WITH RECURSIVE {_CHAINS}
      SELECT walk.id AS source_id, chain_id, chain_pos, array_to_string(list_transform(list_append(above, {{'chain': chain_id, 'upto': chain_pos}}), lambda x: x.chain || '[0..' || x.upto || ']'), ' > ') AS path, n - 1 AS descendants FROM walk JOIN size USING (id)
      UNION ALL SELECT id, '', -1, '', NULL FROM link WHERE id NOT IN (SELECT id FROM walk)""",
    "p3_descendants": f"""WITH RECURSIVE {_CHAINS}, h AS (SELECT chain_id, above, chain_length FROM walk JOIN (SELECT chain_id, count(*) AS chain_length FROM walk GROUP BY chain_id) USING (chain_id) WHERE chain_pos = 0)
      SELECT chain_id, chain_length, x.chain AS below_chain, CAST(x.upto AS BIGINT) AS leaves_at FROM (SELECT chain_id, chain_length, unnest(above) AS x FROM h) UNION ALL SELECT chain_id, chain_length, NULL, NULL FROM h WHERE len(above) = 0""",
    "p3_lineage": f"""WITH RECURSIVE {_LINKS}, newest AS (SELECT source_id AS id FROM source_lifecycle WHERE source_id IS NOT NULL AND source_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY recorded_at DESC, source_id DESC) = 1),
      walk AS (SELECT id, 0 AS d FROM link WHERE parent IS NULL UNION ALL SELECT link.id, d + 1 FROM walk JOIN link ON link.parent = walk.id),
      up AS (SELECT id, id AS node FROM newest WHERE id IN (SELECT id FROM walk) UNION SELECT up.id, parent FROM up JOIN link ON link.id = up.node WHERE parent IS NOT NULL)
      SELECT up.id AS source_id, walk.d AS depth, up.node AS ancestor_id FROM up JOIN walk ON walk.id = up.node""",
    "p3_successors": f"""WITH RECURSIVE {_LINKS}, root AS (SELECT DISTINCT min(id) OVER (PARTITION BY source_key) AS id FROM link JOIN source_lifecycle ON id = source_id WHERE parent IS NULL AND source_key IS NOT NULL),
      down AS (SELECT root.id, link.id AS node FROM root JOIN link ON link.parent = root.id UNION ALL SELECT down.id, link.id FROM down JOIN link ON link.parent = down.node)
      SELECT id AS source_id, node AS descendant_id FROM down""",
    **queries.SQL,
    **knowledge.SQL,
}
