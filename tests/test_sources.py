import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from dayspan.sources import tables


def test_read_parts_union_by_name_with_missing_columns(spark):
    paths = [f"{SF_SMALL}/customer.parquet", f"{SF_SMALL}/supplier.parquet"]
    renames = [{"c_custkey": "k", "c_mktsegment": "segment"}, {"s_suppkey": "k"}]
    df = tables.read_parts(spark, paths, renames=renames, part_col="part")
    n_c = spark.read.parquet(paths[0]).count()
    assert df.where("part = 1 and segment is not null").count() == 0
    assert df.where("part = 0").count() == n_c


def test_hash_sample_is_reproducible(spark):
    c = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    a = tables.hash_sample(c, "o_orderkey", 0.2).select("o_orderkey")
    b = tables.hash_sample(c, "o_orderkey", 0.2).select("o_orderkey")
    assert a.exceptAll(b).count() == 0 and 0.1 < a.count() / c.count() < 0.3


def test_csv_round_trip_with_schema(spark):
    out = tempfile.mkdtemp(prefix="dayspan-csv-")
    df = spark.read.parquet(f"{SF_SMALL}/nation.parquet").withColumn("d", F.current_date())
    tables.write_table(df, out + "/t", fmt="csv")
    back = tables.read_table(spark, out + "/t", fmt="csv",
                             schema="n_nationkey int, n_name string, n_regionkey int, d date")
    assert sorted(back.collect()) == sorted(df.collect())


def test_read_parts_with_schemas_and_options(spark):
    out = tempfile.mkdtemp(prefix="dayspan-parts-")
    for year, text in ((2000, "id;when\n1;2000-01-02\n"), (2001, "id;extra\n2;x\n")):
        with open(f"{out}/{year}.csv", "w") as f:
            f.write(text)
    df = tables.read_parts(spark, [f"{out}/2000.csv", f"{out}/2001.csv"], fmt="csv", part_col="part",
                           schemas=["id int, when date", "id int, extra string"], sep=";")
    assert dict(df.dtypes)["when"] == "date"
    assert sorted((r.part, r.id, str(r.when), r.extra) for r in df.collect()) == [(0, 1, "2000-01-02", None), (1, 2, "None", "x")]


def test_headers_never_clash_and_are_plain(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], ["Name", "NAME", "name", "Größe", "Ærø.", "name_dup"])
    out = tables.normalize_headers(df).columns
    assert len(set(out)) == 6 and out[0] == "name" and out[3:5] == ["grosse", "aero"] and "name_dup2" in out


def test_stage_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from dayspan import session

    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Fake:
        conf = Conf("spark://host:7077")

    with pytest.raises(RuntimeError, match="share"):
        session.ensure_checkpoint_dir(Fake())
    assert session.cluster_conf("hdfs:///tmp/x")["spark.checkpoint.dir"] == "hdfs:///tmp/x"
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")


def test_stage_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from dayspan import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda _: str(tmp_path))
    assert tables.materialize(spark.range(5), "five").count() == 5
    assert session.drop_stage_tables(spark) == 1 and session.drop_stage_tables(spark) == 0


def test_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    """A job that fails midway: old rows whole, nothing left beside them; the same write succeeds later."""
    import os

    import pytest
    path = str(tmp_path / "t")
    tables.write_table(spark.range(100), path)
    bad = spark.range(0, 1000, 1, 8).withColumn("x", F.when(F.col("id") == 990, F.raise_error(F.lit("midway"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="midway"):
        tables.write_table(bad, path)
    assert spark.read.parquet(path).count() == 100 and os.listdir(tmp_path) == ["t"]
    # a table may be replaced by what is read from it
    tables.write_table(spark.read.parquet(path).where("id >= 90"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(90, 100)) and os.listdir(tmp_path) == ["t"]


def test_only_partitions_replaces_what_it_brings(spark, tmp_path):
    import pytest
    path = str(tmp_path / "p")
    rows = spark.range(40).withColumn("year", (F.col("id") % 4 + 2000).cast("int"))
    tables.write_table(rows, path, partition_by=["year"])
    tables.write_table(rows.where("year = 2001").withColumn("id", F.col("id") + 1000), path, partition_by=["year"], only_partitions=True)
    got = spark.read.parquet(path)
    assert got.count() == 40 and got.where("id >= 1000").select("year").distinct().collect()[0].year == 2001
    bad = rows.where("year = 2002").withColumn("id", F.when(F.col("id") == 38, F.raise_error(F.lit("midway"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="midway"):
        tables.write_table(bad, path, partition_by=["year"], only_partitions=True)
    assert spark.read.parquet(path).count() == 40 and spark.read.parquet(path).where("year = 2002").count() == 10
    with pytest.raises(ValueError):
        tables.write_table(rows, path, only_partitions=True)
