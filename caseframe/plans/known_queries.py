"""Hash lists, reference sets, matches and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseframe.operators import known, quality, report
from caseframe.plans.registry import query
from caseframe.plans.views import table, view
from caseframe.schemas import ORDER_MATCHES

# A hash-list line per document: digests in any case with trailing names,
# comments, blanks and tokens that are no digest.
_LIST_LINE_SPARK = (
    "case doc_id % 6 when 0 then '  ' || md5(text) || '  ' || source when 1 then upper(sha1(text))"
    " when 2 then sha2(text, 256) when 3 then '# ' || md5(text) when 4 then substring(md5(text), 1, 31) || 'z'"
    " else text end"
)
_LIST_LINE_DUCK = (
    "CASE doc_id % 6 WHEN 0 THEN '  ' || md5(text) || '  ' || source WHEN 1 THEN upper(sha1(text))"
    " WHEN 2 THEN sha256(text) WHEN 3 THEN '# ' || md5(text) WHEN 4 THEN substr(md5(text), 1, 31) || 'z'"
    " ELSE text END"
)


@query(
    "src_hash_list",
    f"""WITH lines AS (SELECT regexp_replace({_LIST_LINE_DUCK}, '^\\s+|\\s+$', '', 'g') AS line FROM documents),
    tokens AS (SELECT lower(string_split_regex(line, '\\s+')[1]) AS hash FROM lines
      WHERE line <> '' AND NOT starts_with(line, '#'))
    SELECT DISTINCT 'documents' AS list_name, 'allow' AS sense,
      CASE length(hash) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' END AS algo, hash
    FROM tokens WHERE length(hash) IN (32, 40, 64) AND regexp_full_match(hash, '[0-9a-f]+')""",
)
def src_hash_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant hash list: comments, blanks and bad tokens are skipped."""
    lines = table(spark, sf_dir, "documents").selectExpr(f"{_LIST_LINE_SPARK} as value")
    return known.hash_list(lines, "documents", "allow")


_BEST = "CASE MIN(prio) WHEN 1 THEN 'md5' WHEN 2 THEN 'sha1' ELSE 'sha256' END AS matched_on"
_DIGESTS = """digests AS (
  SELECT evidence_source_id, file_id, 1 AS prio, md5 AS hash FROM files_v WHERE md5 IS NOT NULL
  UNION ALL SELECT evidence_source_id, file_id, 2, sha1 FROM files_v WHERE sha1 IS NOT NULL
  UNION ALL SELECT evidence_source_id, file_id, 3, sha256 FROM files_v WHERE sha256 IS NOT NULL)"""
_LISTS = """lists AS (
  SELECT 'toxic' AS list_name, 'block' AS sense, 1 AS prio, md5(text) AS hash
  FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION SELECT 'quality', 'allow', 2, sha1(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1
  UNION SELECT 'quality', 'allow', 3, sha256(text) FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""
_CUSTOM = f"""custom AS (
  SELECT evidence_source_id, file_id, 'custom' AS source, list_name, sense, {_BEST}
  FROM digests JOIN lists USING (prio, hash) GROUP BY evidence_source_id, file_id, list_name, sense)"""
_REFERENCE = """reference AS (
  SELECT upper(md5(body)) AS md5, upper(sha1(body)) AS sha1, upper(sha256(body)) AS sha256
  FROM (SELECT CASE WHEN lang = 'en' THEN text || '#' ELSE text END AS body FROM documents))"""
_NSRL = f"""nsrl AS (
  SELECT evidence_source_id, file_id, 'nsrl' AS source, CAST(NULL AS VARCHAR) AS list_name,
    CAST(NULL AS VARCHAR) AS sense, {_BEST}
  FROM digests WHERE (prio = 1 AND upper(hash) IN (SELECT md5 FROM reference))
    OR (prio = 2 AND upper(hash) IN (SELECT sha1 FROM reference))
    OR (prio = 3 AND upper(hash) IN (SELECT sha256 FROM reference))
  GROUP BY evidence_source_id, file_id)"""
MATCHES_SQL = f"{_DIGESTS}, {_LISTS}, {_CUSTOM}, {_REFERENCE}, {_NSRL}, matches AS (SELECT * FROM custom UNION ALL SELECT * FROM nsrl)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block list of toxic documents (md5) and an allow list of good ones (sha1 and sha256)."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    toxic = labelled.where("toxic = 1").selectExpr("md5(text) as value")
    fine = labelled.where("quality = 1").selectExpr("explode(array(sha1(text), sha2(text, 256))) as value")
    return known.hash_list(toxic, "toxic", "block").unionByName(known.hash_list(fine, "quality", "allow"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case reference hashes of all documents, of English ones in another version; duplicates included."""
    bodies = table(spark, sf_dir, "documents").selectExpr("case when lang = 'en' then text || '#' else text end as body")
    return known.reference_hashes(
        bodies.selectExpr("upper(md5(body)) as md5", "upper(sha1(body)) as sha1", "upper(sha2(body, 256)) as sha256")
    )


def all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files_v")
    return known.match_lists(files, lists(spark, sf_dir)).unionByName(
        known.match_reference(files, reference(spark, sf_dir))
    )


_MATCH_COLUMNS = "evidence_source_id, file_id, source, list_name, sense, matched_on"


@query("known_match", f"WITH {MATCHES_SQL} SELECT {_MATCH_COLUMNS} FROM custom", ("files_v",))
def known_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one match per file and list, by digest priority."""
    return known.match_lists(view(spark, sf_dir, "files_v"), lists(spark, sf_dir))


@query("nsrl_match", f"WITH {MATCHES_SQL} SELECT {_MATCH_COLUMNS} FROM nsrl", ("files_v",))
def nsrl_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in the reference set; duplicate references do not multiply."""
    return known.match_reference(view(spark, sf_dir, "files_v"), reference(spark, sf_dir))


@query(
    "known_matches_ordered",
    f"""WITH {MATCHES_SQL} SELECT m.source, m.list_name, m.sense, m.matched_on, f.file_id, f.volume_id,
      f.volume_offset, f.path FROM matches m JOIN files_v f USING (evidence_source_id, file_id)""",
    ("files_v",),
)
def known_matches_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches with the place of their file, in the declared order."""
    rows = known.with_file_columns(all_matches(spark, sf_dir), view(spark, sf_dir, "files_v"))
    return rows.orderBy(*ORDER_MATCHES).select(
        "source", "list_name", "sense", "matched_on", "file_id", "volume_id", "volume_offset", "path"
    )


@query(
    "search_hash_hits",
    f"""WITH {MATCHES_SQL} SELECT c.file_id, 'metadata' AS region,
      CASE c.matched_on WHEN 'md5' THEN f.md5 WHEN 'sha1' THEN f.sha1 ELSE f.sha256 END AS term,
      'hash' AS term_kind, f.volume_id, f.volume_offset, f.path,
      '{{"list":"' || c.list_name || '","matched_on":"' || c.matched_on || '"}}' AS attributes
    FROM custom c JOIN files_v f USING (evidence_source_id, file_id) WHERE c.sense = 'block'""",
    ("files_v",),
)
def search_hash_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known-hash matches of block lists as search hits with the matched digest."""
    files = view(spark, sf_dir, "files_v")
    blocked = lists(spark, sf_dir).where("sense = 'block'")
    hits = known.hash_hits(known.match_lists(files, blocked), files)
    return hits.select("file_id", "region", "term", "term_kind", "volume_id", "volume_offset", "path", "attributes")


@query(
    "nsrl_by_column",
    f'WITH {MATCHES_SQL} SELECT matched_on AS hash, CAST(COUNT(*) AS BIGINT) AS "count" FROM nsrl GROUP BY 1',
    ("files_v",),
)
def nsrl_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference matches by the digest that matched."""
    return report.nsrl_by_column(all_matches(spark, sf_dir))


@query(
    "custom_by_list",
    f'WITH {MATCHES_SQL} SELECT list_name, sense, CAST(COUNT(*) AS BIGINT) AS "count" FROM custom GROUP BY ALL',
    ("files_v",),
)
def custom_by_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List matches by list and sense."""
    return report.custom_by_list(all_matches(spark, sf_dir))


@query(
    "known_files_distinct",
    f"WITH {MATCHES_SQL} SELECT CAST(COUNT(DISTINCT file_id) AS BIGINT) AS files_matched FROM matches",
    ("files_v",),
)
def known_files_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files matched by anything, counted exactly."""
    return report.known_files_distinct(all_matches(spark, sf_dir))


_MANIFEST_DUCK = """manifest AS (SELECT '/' || doc_id AS path,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN sha256(text || '!')
    WHEN doc_id % 31 = 0 THEN md5(text) || 'zz' WHEN doc_id % 37 = 0 THEN substr(md5(text), 1, 31) || 'g'
    WHEN doc_id % 2 = 0 THEN ' ' || upper(md5(text)) ELSE sha256(text) END AS given FROM documents)"""
_MANIFEST_SPARK = (
    "case when doc_id % 5 = 0 then null when doc_id % 29 = 0 then sha2(text || '!', 256)"
    " when doc_id % 31 = 0 then md5(text) || 'zz' when doc_id % 37 = 0 then substring(md5(text), 1, 31) || 'g'"
    " when doc_id % 2 = 0 then ' ' || upper(md5(text)) else sha2(text, 256) end as supplied"
)


def _computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "'/' || doc_id as path", "doc_id", "text", "md5(text) as md5", "sha2(text, 256) as sha256"
    )


@query(
    "manifest_verify",
    f"""WITH {_MANIFEST_DUCK}, m AS (SELECT path, lower(trim(given)) AS supplied FROM manifest),
    c AS (SELECT '/' || doc_id AS path, md5(text) AS md5, sha256(text) AS sha256 FROM documents),
    j AS (SELECT path, supplied, md5, sha256, CASE WHEN regexp_full_match(supplied, '[0-9a-f]+') THEN
      CASE length(supplied) WHEN 32 THEN 'md5' WHEN 64 THEN 'sha256' END END AS algorithm FROM c JOIN m USING (path))
    SELECT path, supplied, algorithm, CASE WHEN supplied IS NULL THEN 'NOT_COMPARED' WHEN algorithm IS NULL THEN 'MALFORMED'
      WHEN supplied = CASE algorithm WHEN 'md5' THEN md5 ELSE sha256 END THEN 'PASS' ELSE 'FAIL' END AS outcome FROM j""",
)
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied against computed digests per object."""
    computed = _computed(spark, sf_dir)
    return quality.verify_manifest(computed, computed.selectExpr("path", _MANIFEST_SPARK))


# French documents are gone and come back elsewhere; those of one source have moved.
_BASE_PATH = "CASE WHEN lang = 'fr' THEN '/old/' || doc_id ELSE '/' || doc_id END"
_NOW_PATH = "CASE WHEN source = 'src1' THEN '/new/' || doc_id ELSE '/' || doc_id END"


@query(
    "manifest_drift",
    f"""WITH b AS (SELECT {_BASE_PATH} AS path, md5(text) AS base_md5, sha256(text) AS base_sha256 FROM documents),
    c AS (SELECT {_NOW_PATH} AS path, CASE WHEN quality = 1 THEN md5(text || '~') ELSE md5(text) END AS now_md5,
        sha256(text) AS now_sha256 FROM documents LEFT JOIN labels USING (doc_id))
    SELECT COALESCE(b.path, c.path) AS path, base_md5, base_sha256, now_md5, now_sha256,
      CASE WHEN b.path IS NULL THEN 'appeared' WHEN c.path IS NULL THEN 'vanished' ELSE 'changed' END AS drift
    FROM b FULL OUTER JOIN c ON b.path = c.path
    WHERE base_md5 IS DISTINCT FROM now_md5 OR base_sha256 IS DISTINCT FROM now_sha256""",
)
def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that changed, appeared or vanished between two manifests."""
    docs = table(spark, sf_dir, "documents")
    base = docs.selectExpr(f"{_BASE_PATH} as path", "md5(text) as md5", "sha2(text, 256) as sha256")
    now = (
        docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .selectExpr(
            f"{_NOW_PATH} as path",
            "case when quality = 1 then md5(text || '~') else md5(text) end as md5",
            "sha2(text, 256) as sha256",
        )
    )
    return quality.manifest_drift(base, now)
