from types import SimpleNamespace

import pytest

from threadwise import session
from threadwise.session import cut_lineage, passing_tables, settle, shared_folder, spread


def fake(master, folder):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder),
        sparkContext=SimpleNamespace(master=master),
    )


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake("spark://host:7077", None))
    assert shared_folder(fake("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"


def test_cluster_refuses_a_machine_local_folder():
    for folder in ("/tmp/checkpoints", "file:///tmp/x", "file:/var/tmp/y"):
        with pytest.raises(ValueError, match="one machine"):
            shared_folder(fake("yarn", folder))
        assert shared_folder(fake("local[2]", folder)) == folder
    assert shared_folder(fake("yarn", "file:///mnt/shared")) == "file:///mnt/shared"


def test_local_session_may_use_scratch():
    assert shared_folder(fake("local[2]", None)) == shared_folder(fake("local[2]", None))


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(struct(id AS x)) AS nested", "cast(null AS string) AS n")
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, df.collect()))
    assert len(cut.inputFiles()) >= 1


def test_tables_on_the_way_go_with_their_step(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))

    def build():
        first = settle(spark, lambda: cut_lineage(spark.range(3)).selectExpr("id + 1 AS id"))
        assert len(list(tmp_path.iterdir())) == 1
        return first.union(cut_lineage(spark.range(9, 10)))

    kept = settle(spark, build)
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 9]
    with pytest.raises(ZeroDivisionError), passing_tables(spark):
        settle(spark, lambda: spark.range(1))
        cut_lineage(spark.range(1))
        1 / 0
    assert len(list(tmp_path.iterdir())) == 1


def test_spread_only_small_inputs(spark, tmp_path):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == partitions
    spark.range(100).repartition(partitions + 3).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many) is many
