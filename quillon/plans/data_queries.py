"""Queries of the general data-quality operators and their SQL."""

from __future__ import annotations

from quillon.operators import instants, references

ORPHAN_SQL = """
WITH refs AS (
  SELECT 'lnote_claims' AS table_name, claim_order AS row_order, 'source_document_id' AS field_name, 'd' AS target,
         pack_id AS k1, source_document_id AS k2, '' AS k3, ingested_at AS seen_at
  FROM lnote_claims WHERE source_document_id IS NOT NULL
  UNION ALL
  SELECT 'lnote_claims', claim_order, 'source_section_id', 's', pack_id, source_document_id, source_section_id, ingested_at
  FROM lnote_claims WHERE source_section_id IS NOT NULL
  UNION ALL
  SELECT 'lnote_statement_relations', relation_order, f, 'c',
         CASE WHEN strpos(r, '::') > 0 THEN substr(r, 1, strpos(r, '::') - 1) ELSE pack_id END,
         CASE WHEN strpos(r, '::') > 0 THEN substr(r, strpos(r, '::') + 2) ELSE r END, '', ingested_at
  FROM (SELECT relation_order, pack_id, ingested_at, 'source_claim_id' AS f, source_claim_id AS r FROM lnote_statement_relations
        UNION ALL SELECT relation_order, pack_id, ingested_at, 'target_claim_id', target_claim_id FROM lnote_statement_relations) x
  WHERE r IS NOT NULL
), parents AS (
  SELECT target, k1, k2, k3, min(CASE WHEN deleted_at IS NULL THEN ingested_at END) AS live,
         sum(CASE WHEN deleted_at IS NULL THEN 0 ELSE 1 END) AS gone
  FROM (SELECT 'd' AS target, pack_id AS k1, document_id AS k2, '' AS k3, ingested_at, deleted_at FROM lnote_documents
        UNION ALL SELECT 's', pack_id, document_id, section_id, ingested_at, deleted_at FROM lnote_sections
        UNION ALL SELECT 'c', pack_id, claim_id, '', ingested_at, deleted_at FROM lnote_claims) p
  GROUP BY ALL
), probed AS (
  SELECT r.*, CASE WHEN live <= seen_at THEN 'resolved' WHEN live IS NOT NULL THEN 'late' WHEN gone > 0 THEN 'deleted' ELSE 'missing' END AS status
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.k1 = r.k1 AND p.k2 = r.k2 AND p.k3 = r.k3
)
"""

#: State at the end of every batch: what had arrived, and had not been removed, by then.
SNAPSHOT_SQL = """
, delivered AS (
  SELECT 'd' AS target, pack_id AS k1, document_id AS k2, '' AS k3, ingested_at, deleted_at FROM lnote_documents
  UNION ALL SELECT 's', pack_id, document_id, section_id, ingested_at, deleted_at FROM lnote_sections
  UNION ALL SELECT 'c', pack_id, claim_id, '', ingested_at, deleted_at FROM lnote_claims
), quarters AS (SELECT DISTINCT date_trunc('quarter', t)::DATE AS q FROM (SELECT ingested_at AS t FROM delivered UNION ALL SELECT seen_at FROM refs) x WHERE t IS NOT NULL
), batches AS (SELECT lead(q) OVER (ORDER BY q) AS until FROM quarters
), live AS (
  SELECT until, target, k1, k2, k3, min(ingested_at) AS first_at FROM delivered, batches
  WHERE (until IS NULL OR coalesce(ingested_at < until, true)) AND (deleted_at IS NULL OR deleted_at >= until) GROUP BY ALL
), state AS (
  SELECT r.table_name, r.field_name, b.until, r.seen_at, l.first_at FROM refs r JOIN batches b ON b.until IS NULL OR coalesce(r.seen_at < b.until, true)
  LEFT JOIN live l ON l.until IS NOT DISTINCT FROM b.until AND l.target = r.target AND l.k1 = r.k1 AND l.k2 = r.k2 AND l.k3 = r.k3
)
SELECT table_name, field_name, count(*) AS seen, sum((first_at IS NULL)::INT)::BIGINT AS waiting, sum(coalesce(first_at > seen_at, first_at IS NOT NULL)::INT)::BIGINT AS resolved_late,
       CASE WHEN until IS NULL THEN 'all' ELSE 'before ' || strftime(until, '%Y-%m-%d') END AS snapshot
FROM state GROUP BY ALL
"""


def queries() -> dict:
    return {
        "p1_found": references.found,
        "p1_counts": references.counts,
        "p1_snapshots": references.snapshots,
        "p2_found": instants.found,
        "p2_instants": instants.normalised,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_snapshots": ORPHAN_SQL.split(", probed AS")[0].replace("), parents AS (", "), parents0 AS (") + SNAPSHOT_SQL,
        "p1_found": ORPHAN_SQL + "SELECT DISTINCT table_name, row_order, field_name FROM probed WHERE status <> 'resolved'",
        "p1_counts": ORPHAN_SQL
        + """SELECT table_name, field_name, strftime(seen_at, '%Y-%m') AS month, count(*) AS reference_count,
             sum(CASE WHEN status <> 'resolved' THEN 1 ELSE 0 END)::BIGINT AS orphan_count,
             sum(CASE WHEN status = 'late' THEN 1 ELSE 0 END)::BIGINT AS late_count,
             sum(CASE WHEN status = 'deleted' THEN 1 ELSE 0 END)::BIGINT AS deleted_count,
             sum(CASE WHEN status = 'missing' THEN 1 ELSE 0 END)::BIGINT AS missing_count
             FROM probed GROUP BY table_name, field_name, strftime(seen_at, '%Y-%m')""",
    }
