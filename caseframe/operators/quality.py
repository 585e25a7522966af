"""Checks: schemas, references, vocabularies, attributes, digests of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseframe import schemas
from caseframe.functions import attributes, hashes


class SchemaDrift(ValueError):
    """A table and its declared schema disagree."""


def schema_drift(df: DataFrame, schema: T.StructType) -> list[str]:
    """Differences in either direction, as readable lines; empty when equal."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    out = [f"missing column {n}" for n in sorted(want.keys() - have.keys())]
    out += [f"unexpected column {n}" for n in sorted(have.keys() - want.keys())]
    out += [
        f"column {n} is {have[n].simpleString()}, expected {want[n].simpleString()}"
        for n in sorted(want.keys() & have.keys())
        if have[n] != want[n]
    ]
    return out


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    problems = schema_drift(df, schema)
    if problems:
        raise SchemaDrift("; ".join(problems))
    return df


def require_utc(df: DataFrame) -> DataFrame:
    """Instants only (no zone-less timestamps), in a UTC session."""
    if df.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
        raise SchemaDrift("session time zone is not UTC")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if naive:
        raise SchemaDrift(f"zone-less timestamps: {naive}")
    return df


def orphan_references(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose non-null key has no parent; empty when references hold."""
    present = child.where(" and ".join(f"{k} is not null" for k in keys))
    return present.join(parent.select(*keys), keys, "left_anti")


def outside_domain(df: DataFrame, table: str) -> DataFrame:
    """Rows with a value outside the closed vocabulary of the table."""
    broken = F.lit(False)
    for column, allowed in schemas.ENUMS.get(table, {}).items():
        broken = broken | (F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
    return df.where(broken)


def invalid_attributes(df: DataFrame, column: str = "attributes") -> DataFrame:
    """Rows whose attributes are not a JSON object."""
    return df.where(~attributes.is_json_object(F.col(column)))


def only_new(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet (idempotent append)."""
    return rows.join(existing.select(*keys), keys, "left_anti")


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Computed against supplied digests per path.

    ``files``: path, md5, sha256. ``manifest``: path, supplied. Outcomes: PASS,
    FAIL, NOT_COMPARED (nothing supplied), MALFORMED (not an md5/sha256 hex).
    """
    given = F.lower(F.regexp_replace("supplied", r"^\s+|\s+$", ""))
    rows = files.select("path", "md5", "sha256").join(
        manifest.select("path", given.alias("supplied")), "path", "left"
    )
    algo = hashes.algorithm_of(F.col("supplied"))
    usable = F.coalesce(algo.isin("md5", "sha256"), F.lit(False)) & hashes.is_hex(F.col("supplied"))
    computed = F.when(algo == "md5", F.lower("md5")).when(algo == "sha256", F.lower("sha256"))
    return rows.select(
        "path",
        "supplied",
        F.when(usable, algo).alias("algorithm"),
        F.when(F.col("supplied").isNull(), "NOT_COMPARED")
        .when(~usable, "MALFORMED")
        .when(computed.eqNullSafe(F.col("supplied")), "PASS")
        .otherwise("FAIL")
        .alias("outcome"),
    )


def manifest_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose digests changed, appeared or vanished between two manifests."""
    b = baseline.select("path", F.col("md5").alias("base_md5"), F.col("sha256").alias("base_sha256"))
    c = current.select("path", F.col("md5").alias("now_md5"), F.col("sha256").alias("now_sha256"))
    both = b.withColumn("_b", F.lit(True)).join(c.withColumn("_c", F.lit(True)), "path", "full_outer")
    same = F.col("base_md5").eqNullSafe(F.col("now_md5")) & F.col("base_sha256").eqNullSafe(F.col("now_sha256"))
    kind = (
        F.when(F.col("_b").isNull(), "appeared").when(F.col("_c").isNull(), "vanished").otherwise("changed")
    )
    return both.withColumn("drift", kind).where((F.col("drift") != "changed") | ~same).drop("_b", "_c")


def acquisition_rows(verified: DataFrame, evidence_source_id: int) -> DataFrame:
    """``verify_manifest`` as rows of ``integrity_checks``."""
    return _check_rows(verified, "acquisition", evidence_source_id)


def drift_rows(drift: DataFrame, evidence_source_id: int) -> DataFrame:
    """``manifest_drift`` as rows of ``integrity_checks``; ``supplied`` is the earlier SHA-256."""
    rows = drift.select("path", F.col("base_sha256").alias("supplied"), F.lit("sha256").alias("algorithm"), F.col("drift").alias("outcome"))
    return _check_rows(rows, "reverify", evidence_source_id)


def _check_rows(rows: DataFrame, check: str, evidence_source_id: int) -> DataFrame:
    return rows.select(
        F.lit(evidence_source_id).cast("long").alias("evidence_source_id"), F.lit(check).alias("check"),
        "path", "supplied", "algorithm", "outcome",
    )


def result_digest(df: DataFrame, row_text: Column | None = None) -> DataFrame:
    """Order-free digest of a result: row count and sum of 60-bit row hashes.

    Equal results give equal digests whatever the partitioning. The hashes are
    summed in three parts of 20 bits, as plain integers that cannot overflow.
    """
    text = row_text
    if text is None:
        text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    bits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("b")
    mask = (1 << 20) - 1
    parts = df.select(bits).agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.coalesce(F.sum(F.shiftright("b", 20 * i).bitwiseAND(F.lit(mask))), F.lit(0)).alias(f"s{i}")
            for i in range(3)
        ],
    )
    total = sum(
        (F.col(f"s{i}").cast("decimal(38,0)") * F.lit(1 << (20 * i)).cast("decimal(20,0)") for i in (1, 2)),
        F.col("s0").cast("decimal(38,0)"),
    )
    return parts.select("rows", total.cast("decimal(38,0)").cast("string").alias("digest"))
