"""Row-wise operators on a stream give the batch result."""

import hashlib

from pyspark.sql import functions as F

from caseframe import streaming
from caseframe.operators import known
from caseframe.operators.logs import parse


def test_heads_and_known_on_a_stream(spark, tmp_path):
    body = [f"Jan  {1 + i % 9} 00:00:00 h sshd[{i}]: Failed password for u{i} from x" for i in range(50)]
    lines = spark.createDataFrame([(0, "/l/auth.log", i, 0, b) for i, b in enumerate(body)], "volume_id long, path string, line_ord long, line_sub int, line string")
    lines.write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    q = streaming.stream_heads(stream).writeStream.format("parquet").option("path", str(tmp_path / "heads")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.line_ord, r.actor) for r in spark.read.parquet(str(tmp_path / "heads")).collect())
    assert got == sorted((r.line_ord, r.actor) for r in parse.parse(lines).collect())

    h = hashlib.md5(b"x").hexdigest()
    files = spark.range(40).select(F.lit(1).cast("long").alias("evidence_source_id"), F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, h).alias("md5"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("string").alias("sha256"))
    files.repartition(2).write.parquet(str(tmp_path / "files"))
    lists = known.hash_list(spark.createDataFrame([(h,)], "value string"), "l", "allow")
    source = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "files"))
    streaming.stream_known(source, lists, str(tmp_path / "known"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "known")).count() == known.match_lists(files, lists).count() == 14
