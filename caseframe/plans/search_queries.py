"""Content search over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseframe.operators import known, recovery, report, search
from caseframe.operators.ordered import settled, spread
from caseframe.plans.known_queries import MATCHES_SQL, lists
from caseframe.plans.registry import query
from caseframe.plans.views import table, view
from caseframe.schemas import ORDER_HITS

# Words that occur in the texts and one that does not; none overlaps itself.
LITERALS = (b" the", b"License", b"example.com", b"onen", b"no such words here")
IOC = (b"@", b"://", b"License", b"absent-indicator.invalid")
MAIL = r"[a-z0-9.]+@[a-z0-9]+\.[a-z]{2,}"
NUMBER = r"\d{1,3}(?:\.\d{1,3}){3}"

CHUNK = 256
BLOCK = 128


def _text(literal: bytes) -> str:
    return literal.decode("latin-1").replace("'", "''")


def _terms_sql(*groups: tuple[tuple[bytes, ...], str]) -> str:
    rows = ", ".join(f"('{_text(t)}', '{kind}')" for terms, kind in groups for t in terms)
    return f"terms AS (SELECT * FROM (VALUES {rows}) v(term, term_kind))"


def literal_hits_sql(source: str, columns: str, name: str = "lit") -> str:
    """Offsets in bytes from the pieces between occurrences."""
    return f"""{name}_pieces AS (SELECT {columns}, term, term_kind, string_split(content_text, term) AS p
      FROM {source} JOIN terms ON contains(content_text, term)),
    {name}_rows AS (SELECT * EXCLUDE (p), unnest(p) AS piece, unnest(range(len(p))) AS i, len(p) AS n FROM {name}_pieces),
    {name}_hits AS (SELECT {columns}, term, term_kind, i, n, CAST(SUM(strlen(piece) + strlen(term)) OVER
      (PARTITION BY {columns.split(', ')[0]}, term, term_kind ORDER BY i) - strlen(term) AS BIGINT) AS byte_offset FROM {name}_rows)"""


def regex_hits_sql(source: str, columns: str, pattern: str, name: str) -> str:
    """Offsets of regex matches from the pieces between them."""
    return f"""{name}_p AS (SELECT {columns}, string_split_regex(content_text, '{pattern}') AS p,
      regexp_extract_all(content_text, '{pattern}') AS m FROM {source} WHERE regexp_matches(content_text, '{pattern}')),
    {name}_r AS (SELECT * EXCLUDE (p, m), unnest(p[1:len(m)]) AS piece, unnest(m) AS term, unnest(range(len(m))) AS i FROM {name}_p),
    {name} AS (SELECT {columns}, term, 'regex' AS term_kind, CAST(SUM(strlen(piece) + strlen(term)) OVER
      (PARTITION BY {columns.split(', ')[0]} ORDER BY i) - strlen(term) AS BIGINT) AS byte_offset FROM {name}_r)"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "files_v").withColumn("content", F.col("content_text").cast("binary"))
    return search.searchable(files).select(
        "evidence_source_id", "file_id", "volume_id", "volume_offset", "path", "content"
    )


_OBJECTS = "objects AS (SELECT * FROM files_v WHERE meta_type = 'reg' AND allocated AND size > 0)"
_PLACE = "file_id, volume_id, volume_offset, path"
_OUT = ["file_id", "volume_id", "volume_offset", "path", "term", "term_kind", "byte_offset"]


@query(
    "search_literal",
    f"""WITH {_OBJECTS}, {_terms_sql((LITERALS, 'literal'))}, {literal_hits_sql('objects', _PLACE)}
    SELECT {', '.join(_OUT)} FROM lit_hits WHERE i < n - 1""",
    ("files_v",),
)
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal hits with byte offsets in the declared order."""
    hits = search.search_objects(_objects(spark, sf_dir), [(t, "literal") for t in LITERALS])
    return settled(hits).orderBy(*ORDER_HITS).select(_OUT)


@query(
    "search_ioc",
    f"""WITH {_OBJECTS}, {_terms_sql((IOC, 'ioc'))}, {literal_hits_sql('objects', _PLACE)}
    SELECT {', '.join(_OUT)} FROM lit_hits WHERE i < n - 1""",
    ("files_v",),
)
def search_ioc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator hits."""
    return search.search_objects(_objects(spark, sf_dir), [(t, "ioc") for t in IOC]).select(_OUT)


WORD = "[A-Za-z]+"


# A term is a run of letters, so each of its occurrences lies in one run of letters of the content.
@query(
    "search_ioc_table",
    f"""WITH {_OBJECTS}, terms AS (SELECT DISTINCT item_word AS term FROM (
        SELECT unnest(regexp_extract_all(text, '{WORD}')) AS item_word FROM benchmark)),
    {regex_hits_sql('objects', 'file_id', WORD, 'word')},
    words AS (SELECT DISTINCT term AS w FROM word),
    near AS (SELECT w, term, unnest(range(strlen(w) - strlen(term) + 1)) AS i FROM words JOIN terms ON contains(w, term))
    SELECT file_id, near.term, byte_offset + i AS byte_offset FROM word JOIN near ON word.term = near.w
    WHERE substring(w, i + 1, strlen(near.term)) = near.term""",
    ("files_v",),
)
def search_ioc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of every word of a long list of indicators, found where the content lies."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    terms = words.select(F.col("w").cast("binary").alias("term"), F.lit("ioc").alias("kind"))
    objects = spread(_objects(spark, sf_dir).select("file_id", "content"))
    hits = search.search_term_table(objects, terms, context=False)
    return hits.select("file_id", "term", "byte_offset")


_PAGES = "objects AS (SELECT page_id AS file_id, url AS path, html AS content_text FROM pages UNION ALL SELECT 1000000000 + doc_id, source, text FROM documents)"


@query(
    "search_regex",
    f"""WITH {_PAGES}, {regex_hits_sql('objects', 'file_id, path', MAIL, 'mail')}, {regex_hits_sql('objects', 'file_id, path', NUMBER, 'num')}
    SELECT file_id, path, term, term_kind, byte_offset FROM (SELECT * FROM mail UNION ALL SELECT * FROM num)""",
)
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex hits over pages and documents."""
    pages = table(spark, sf_dir, "pages").selectExpr("page_id as file_id", "url as path", "cast(html as binary) as content")
    docs = table(spark, sf_dir, "documents").selectExpr(
        "1000000000 + doc_id as file_id", "source as path", "cast(text as binary) as content"
    )
    hits = search.search_objects(pages.unionByName(docs), regexes=[MAIL, NUMBER])
    return hits.select("file_id", "path", "term", "term_kind", "byte_offset")


def _pieces(docs: DataFrame, size: int) -> DataFrame:
    """Contents cut in pieces of a fixed size."""
    n = F.octet_length("content")
    cut = docs.where(n > 0).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size))).alias("no"), "content"
    )
    return cut.select(
        "doc_id",
        "no",
        (F.col("no") * size).alias("base"),
        F.substring(F.col("content"), (F.col("no") * size + 1).cast("int"), F.lit(size)).alias("data"),
    )


_DOCS = "objects AS (SELECT doc_id AS object_id, text AS content_text FROM documents)"


@query(
    "search_chunked",
    f"""WITH {_DOCS}, {_terms_sql((LITERALS, 'literal'))}, {literal_hits_sql('objects', 'object_id')},
    {regex_hits_sql('objects', 'object_id', MAIL, 'mail')}
    SELECT object_id, term, term_kind, byte_offset FROM lit_hits WHERE i < n - 1
    UNION ALL SELECT object_id, term, term_kind, byte_offset FROM mail""",
)
def search_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in contents stored as 256-byte chunks equal the hits in the whole contents."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(text as binary) as content")
    chunks = _pieces(docs, CHUNK).select(F.col("doc_id").alias("object_id"), "base", "data")
    hits = search.search_chunks(chunks, ["object_id"], [(t, "literal") for t in LITERALS], [MAIL])
    return hits.select("object_id", "term", "term_kind", "byte_offset")


#: Five bytes of a line: where its matches fall depends on where a scan enters a line.
DENSE = r"[^\n]{5}"
DENSE_WINDOW = 8 << 10

# Texts as ASCII of the same length in bytes.
_PLAIN = r"""plain AS (SELECT doc_id AS object_id, regexp_replace(regexp_replace(regexp_replace(text,
      '[\x{80}-\x{7ff}]', '??', 'g'), '[\x{800}-\x{ffff}]', '???', 'g'), '[\x{10000}-\x{10ffff}]', '????', 'g') AS content_text FROM documents)"""


@query(
    "search_chunked_dense",
    f"""WITH {_PLAIN}, {regex_hits_sql('plain', 'object_id', DENSE, 'dense')} SELECT object_id, term_kind, byte_offset FROM dense""",
)
def search_chunked_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that matches nearly everywhere, over contents of many small windows."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(text as binary) as content")
    chunks = _pieces(docs, 2048).select(F.col("doc_id").alias("object_id"), "base", "data")
    hits = search.search_chunks(chunks, ["object_id"], regexes=[DENSE], window=DENSE_WINDOW)
    return hits.select("object_id", "term_kind", "byte_offset")


_DOC_ORIGIN = 4096


def _block_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document as a volume of blocks; every fourth block belongs to an allocated inode."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(text as binary) as content")
    blocks = _pieces(docs, BLOCK).select(
        F.col("doc_id").alias("volume_id"),
        F.lit(_DOC_ORIGIN).cast("long").alias("volume_offset"),
        F.col("no").alias("block_index"),
        "data",
    )
    owners = docs.select(
        F.col("doc_id").alias("volume_id"),
        F.lit(True).alias("allocated"),
        F.transform(
            F.sequence(F.lit(3), F.greatest(F.lit(3), F.ceil(F.octet_length("content") / BLOCK).cast("int")), F.lit(4)),
            lambda b: F.struct(b.cast("long").alias("start"), F.lit(1).cast("long").alias("len")),
        ).alias("runs"),
    )
    return blocks, owners


def block_hits(spark: SparkSession, sf_dir: str, regexes: tuple[str, ...] = ()) -> DataFrame:
    blocks, owners = _block_inputs(spark, sf_dir)
    free = recovery.unallocated(blocks, owners)
    return search.search_blocks(free, BLOCK, [(t, "literal") for t in LITERALS], regexes)


# A hit survives when no block it touches is the last of a group of four.
_BLOCK_HITS = f"""block_docs AS (SELECT doc_id AS volume_id, text AS content_text FROM documents),
    {literal_hits_sql('block_docs', 'volume_id', 'block').replace('JOIN terms', "JOIN (SELECT * FROM terms WHERE term_kind = 'literal')")},
    block_ends AS (SELECT *, byte_offset // {BLOCK} AS b0, (byte_offset + strlen(term) - 1) // {BLOCK} AS b1
      FROM block_hits WHERE i < n - 1),
    free_hits AS (SELECT volume_id, term, term_kind, byte_offset + {_DOC_ORIGIN} AS byte_offset, b0 AS block_index
      FROM block_ends WHERE NOT (b0 % 4 = 3 OR b1 // 4 > b0 // 4 OR b1 % 4 = 3))"""
_STRETCH = 4 * BLOCK


@query(
    "search_blocks",
    f"""WITH {_terms_sql((LITERALS, 'literal'))}, {_BLOCK_HITS}, {_PLAIN},
    stretches AS (SELECT object_id * 1000000 + g AS place, object_id, g, substring(content_text, g * {_STRETCH} + 1, {3 * BLOCK}) AS content_text
      FROM (SELECT *, unnest(range((strlen(content_text) + {_STRETCH - 1}) // {_STRETCH})) AS g FROM plain)),
    {regex_hits_sql('stretches', 'place, object_id, g', DENSE, 'dense')},
    found AS (SELECT volume_id, term_kind, byte_offset, block_index FROM free_hits
      UNION ALL SELECT object_id, term_kind, byte_offset + g * {_STRETCH} + {_DOC_ORIGIN}, (byte_offset + g * {_STRETCH}) // {BLOCK} FROM dense)
    SELECT volume_id, term_kind, 'unallocated' AS region, CAST(byte_offset AS BIGINT) AS byte_offset,
      CAST(block_index AS BIGINT) AS block_index FROM found""",
)
def search_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals and a dense pattern in unallocated blocks; nothing matches across an allocated block."""
    return block_hits(spark, sf_dir, (DENSE,)).select("volume_id", "term_kind", "region", "byte_offset", "block_index")


_ALL_SQL = f"""WITH {MATCHES_SQL}, objects AS (SELECT *, file_id AS object_id FROM files_v WHERE meta_type = 'reg' AND allocated AND size > 0),
    {_terms_sql((LITERALS, 'literal'), (IOC, 'ioc'))}, {literal_hits_sql('objects', 'file_id')}, {regex_hits_sql('objects', 'file_id', MAIL, 'mail')},
    {_BLOCK_HITS},
    hash_hits AS (SELECT c.file_id, 'hash' AS term_kind, 'metadata' AS region,
      CASE c.matched_on WHEN 'md5' THEN f.md5 WHEN 'sha1' THEN f.sha1 ELSE f.sha256 END AS term
      FROM custom c JOIN files_v f USING (evidence_source_id, file_id) WHERE c.sense = 'block'),
    arms AS (SELECT file_id, 'allocated' AS region, term, term_kind, byte_offset FROM lit_hits WHERE i < n - 1
      UNION ALL SELECT file_id, 'allocated', term, term_kind, byte_offset FROM mail
      UNION ALL SELECT NULL, 'unallocated', term, term_kind, byte_offset FROM free_hits
      UNION ALL SELECT file_id, region, term, term_kind, NULL FROM hash_hits)"""


def all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal, indicator and regex hits in one pass over the contents, hits in unallocated blocks, and hash hits."""
    terms = [(t, "literal") for t in LITERALS] + [(t, "ioc") for t in IOC]
    content = search.search_objects(_objects(spark, sf_dir), terms, [MAIL])
    files = view(spark, sf_dir, "files_v")
    blocked = known.match_lists(files, lists(spark, sf_dir).where("sense = 'block'"))
    return content.unionByName(block_hits(spark, sf_dir)).unionByName(known.hash_hits(blocked, files))


@query("search_all_arms", f"{_ALL_SQL} SELECT file_id, region, term, term_kind, byte_offset FROM arms", ("files_v",))
def search_all_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms of a search in the declared order."""
    hits = settled(all_hits(spark, sf_dir)).orderBy(*ORDER_HITS)
    return hits.select("file_id", "region", "term", "term_kind", "byte_offset")


@query(
    "search_by_region_kind",
    f"""{_ALL_SQL}, counts AS (SELECT 'region' AS breakdown, region AS label FROM arms
      UNION ALL SELECT 'term_kind', term_kind FROM arms)
    SELECT breakdown, label, CAST(COUNT(*) AS BIGINT) AS "count" FROM counts GROUP BY ALL""",
    ("files_v",),
)
def search_by_region_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per region and per kind."""
    return report.search_by_region_kind(all_hits(spark, sf_dir))


@query(
    "search_run_counts",
    f"""{_ALL_SQL} SELECT CAST(COUNT(*) AS BIGINT) AS hits, CAST(COUNT(*) FILTER (WHERE region = 'unallocated') AS BIGINT) AS unallocated_hits,
      CAST(COUNT(*) FILTER (WHERE term_kind = 'hash') AS BIGINT) AS hash_hits FROM arms""",
    ("files_v",),
)
def search_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a search run."""
    return report.search_run_counts(all_hits(spark, sf_dir))
