"""Tables in the shared folder."""

from pathlib import Path

from pyspark.sql import functions as F

from docproof.llm.store import CLEANED, dropped, settled


def test_settled_leaves_no_shuffle_files(spark):
    """What the table was made by lies on no disk any more when it has been written, and the session is as it was."""
    local = Path(str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0]))
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    before, conf = files(), spark.conf.get(CLEANED, None)
    rows = spark.range(10_000).select((F.col("id") % 10).alias("k"), "id").repartition(3, "k")
    table = settled(rows.groupBy("k").agg(F.count("*").alias("n")))
    assert not files() - before and spark.conf.get(CLEANED, None) == conf
    assert table.count() == 10 and rows.count() == 10_000
    dropped(table)
