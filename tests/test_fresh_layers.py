"""Layers follow their source files; versions are swapped whole; models are
found again."""

import os
import shutil
import subprocess
import sys
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from wicketlake.ml import registry as R
from wicketlake.plans import registry, silver
from wicketlake.sources import layers, tables, versioned, views
from wicketlake.sources.tables import Tables
from wicketlake.sources.versioned import VersionedTable

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def add_file(df, folder, name):
    """``df`` as one more Parquet file of a folder."""
    made = f"{folder}-{uuid4().hex}"
    df.coalesce(1).write.parquet(made)
    part = next(f for f in os.listdir(made) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    shutil.copy(f"{made}/{part}", f"{folder}/{name}.parquet")


@pytest.fixture
def source(spark, tmp_path):
    """A source folder whose tables have one file each: the first orders."""
    lineitem, orders = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "orders"))
    edge = orders.approxQuantile("o_orderkey", [0.5], 0)[0]
    halves = {"lineitem": (lineitem.filter(F.col("l_orderkey") <= edge), lineitem.filter(F.col("l_orderkey") > edge)),
              "orders": (orders.filter(F.col("o_orderkey") <= edge), orders.filter(F.col("o_orderkey") > edge))}
    for name, (first, _) in halves.items():
        add_file(first, str(tmp_path / f"{name}.parquet"), "a")
    return str(tmp_path), halves


def expected(t):
    deliveries = views.deliveries(t.lineitem)
    matches = views.matches(t.orders)
    cards = silver.match_cards(deliveries)
    return {"deliveries": deliveries, "matches": matches, "cards": cards, "players": silver.players_from_cards(cards, matches),
            "clean_matches": silver.transform_matches(matches)}


def check_layers(spark, folder, *names):
    """The named layers (default: all) equal a build from all files."""
    t = Tables(spark, folder)
    for name, want in expected(t).items():
        if names and name not in names:
            continue
        got = getattr(t, name)
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows_of(got) == rows_of(want), name


def spoil(folder, name):
    """Garbage of the same size and time in place of a file that was read."""
    path = f"{folder}/{name}.parquet/a.parquet"
    at = os.stat(path)
    with open(path, "wb") as f:
        f.write(b"x" * at.st_size)
    os.utime(path, ns=(at.st_atime_ns, at.st_mtime_ns))


def test_appended_files_change_the_next_query(spark, source):
    folder, halves = source
    first = Tables(spark, folder).deliveries.count()
    Tables(spark, folder).players  # noqa: B018
    for name, (_, second) in halves.items():
        add_file(second, f"{folder}/{name}.parquet", "b")
    check_layers(spark, folder)  # equals a full build; matches that both files hold are merged
    assert Tables(spark, folder).deliveries.count() > first
    q = registry.spark_queries()["b9_fact_match_performance"]
    assert rows_of(q(spark, folder)) == rows_of(q(spark, SF))


def test_layers_are_dealt_as_numbers(spark, source, monkeypatch):
    """A whole build shuffles every ball once, without the texts made from its
    numbers, sorts no sides of balls, and has buckets for large sources."""
    folder, _ = source
    plans, commit = {}, VersionedTable.commit

    def caught(table, rows, *args, **kwargs):
        explain = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
        plans[table.root.rsplit("/", 1)[-1]] = explain(rows._jdf.queryExecution(), "formatted").split("\n\n")
        return commit(table, rows, *args, **kwargs)

    monkeypatch.setattr(VersionedTable, "commit", caught)
    monkeypatch.setattr(layers, "BUCKET_BYTES", os.path.getsize(f"{folder}/lineitem.parquet/a.parquet") // 20)
    t = Tables(spark, folder)
    t.deliveries, t.cards  # noqa: B018
    for name in ("deliveries", "cards"):
        moved = [block for block in plans[name] if ") Exchange" in block]
        assert len(moved) == 1, plans[name]
        assert not any(c in moved[0] for c in ("batsman", "bowler", "team", "match_id", "dismissal")), moved
        assert VersionedTable(spark, f"{t.store}/{name}", []).head().buckets >= 20
    assert any(") HashAggregate" in block for block in plans["cards"])
    check_layers(spark, folder)


def test_old_files_are_not_read_again(spark, source):
    folder, halves = source
    t = Tables(spark, folder)
    t.deliveries, t.cards, t.matches  # noqa: B018
    for name, (_, second) in halves.items():
        spoil(folder, name)
        add_file(second, f"{folder}/{name}.parquet", "b")
    t = Tables(spark, folder)
    whole = Tables(spark, SF)
    for name in ("deliveries", "cards", "matches"):
        assert rows_of(getattr(t, name)) == rows_of(getattr(whole, name)), name
    with pytest.raises(Exception, match="a.parquet"):
        t.lineitem.agg(F.sum("l_quantity")).collect()


def test_untouched_buckets_keep_their_files(spark, source):
    folder, halves = source
    t = Tables(spark, folder)
    t.cards  # noqa: B018
    table = VersionedTable(spark, f"{t.store}/cards", ["match_id"])
    before = table.head()
    one = halves["lineitem"][0].orderBy("l_orderkey").limit(3)
    add_file(one.withColumn("l_partkey", F.lit(1).cast("bigint")), f"{folder}/lineitem.parquet", "c")
    Tables(spark, folder).cards  # noqa: B018
    after = table.head()
    changed = [b for b in after.folders if after.folders[b] != before.folders.get(b)]
    assert after.number == before.number + 1 and 0 < len(changed) < len(after.folders)
    check_layers(spark, folder, "cards")


def test_changed_and_removed_files_rebuild(spark, source):
    folder, halves = source
    t = Tables(spark, folder)
    t.deliveries, t.players  # noqa: B018
    for name, (_, second) in halves.items():
        os.remove(f"{folder}/{name}.parquet/a.parquet")
        add_file(second, f"{folder}/{name}.parquet", "b")
    check_layers(spark, folder, "deliveries", "players")


def test_unchanged_sources_build_nothing(spark, source, monkeypatch):
    folder, _ = source
    t = Tables(spark, folder)
    t.deliveries, t.players, t.clean_matches  # noqa: B018
    layers._HEADS.clear()
    tables._DERIVED.clear()  # as a second application would start

    def fail(*_, **__):
        raise AssertionError("built again")

    monkeypatch.setattr(layers, "_refreshed", fail)
    monkeypatch.setattr(silver, "players_from_cards", fail)
    t = Tables(spark, folder)
    assert t.deliveries.count() and t.players.count() and t.clean_matches.count()


def test_empty_source(spark, source):
    folder, halves = source
    for name, (first, _) in halves.items():
        os.remove(f"{folder}/{name}.parquet/a.parquet")
        add_file(first.limit(0), f"{folder}/{name}.parquet", "empty")
    t = Tables(spark, folder)
    assert t.deliveries.count() == t.cards.count() == t.matches.count() == 0
    for name, (first, _) in halves.items():
        add_file(first, f"{folder}/{name}.parquet", "a")
    check_layers(spark, folder, "cards", "matches")


# Upserts ---------------------------------------------------------------------

def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    docs = spark.range(500).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), F.lit("old").alias("text"))
    table = VersionedTable(spark, f"file://{tmp_path}/docs", ["id"], buckets=16)
    one = table.commit(table.placed(docs), None)
    assert len(one.folders) == 16
    incoming = spark.createDataFrame([("d7", "new"), ("d7", "newer"), ("fresh", "new")], "id string, text string")
    two = table.upsert(incoming)
    touched = {b for b in two.folders if two.folders[b] != one.folders[b]}
    assert 1 <= len(touched) <= 2 and table.head() == two
    got = {r.id: r.text for r in table.read(two).collect()}
    assert len(got) == 501 and got["d7"] == "newer" and got["fresh"] == "new" and got["d8"] == "old"
    assert {r.text for r in table.read(one).select("text").distinct().collect()} == {"old"}  # older readers go on


def test_a_bucket_has_a_task_of_its_own(spark, tmp_path):
    docs = spark.range(3000).select("id", (F.col("id") % 7).alias("x")).unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS id, 1L AS x"))
    table = VersionedTable(spark, f"file://{tmp_path}/docs", ["id"], buckets=48)
    dealt = table.placed(docs).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct(versioned.BUCKET).alias("n"), F.count("*").alias("rows"))
    found = dealt.collect()
    assert len(found) == 48 and {r.n for r in found} == {1} and sum(r.rows for r in found) == 3001


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "old") for i in range(40)], "id string, text string")
    table = VersionedTable(spark, f"file://{tmp_path}/docs", ["id"], buckets=4)
    one = table.commit(table.placed(docs), None)
    broken = spark.createDataFrame([("d1", "x")], "id string, text string").withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.head() == one and {r.text for r in table.read(one).collect()} == {"old"}
    # Two writers of the same next version: the second one fails.
    table.commit(table.placed(docs, 4), one, replaced=set())
    with pytest.raises(Exception, match="(?i)exist"):
        table.commit(table.placed(docs, 4), one, replaced=set())


# Models ----------------------------------------------------------------------

def test_store_finds_models_by_content(spark, tmp_path):
    from wicketlake.ml import models as M

    rows = spark.range(60).select(F.col("id").alias("player_name"), *[(F.col("id") * k % 17).cast("double").alias(f"x{k}") for k in (1, 3, 5)])
    cols, made = ["x1", "x3", "x5"], []

    def train():
        made.append(1)
        return M.cluster_players(rows, cols, k=2, starts=1, max_iter=5)[0]

    first = R.stored("test-clusters", rows, {"k": 2, "run": str(tmp_path)}, cols, train)
    R._SEEN.clear()  # as a second application would start
    again = R.stored("test-clusters", rows.repartition(7), {"run": str(tmp_path), "k": 2}, cols, train)
    assert len(made) == 1
    assert rows_of(first.transform(rows).select("player_name", "cluster")) == rows_of(again.transform(rows).select("player_name", "cluster"))
    R.stored("test-clusters", rows.withColumn("x1", F.col("x1") + 1), {"k": 2, "run": str(tmp_path)}, cols, train)
    R.stored("test-clusters", rows, {"k": 3, "run": str(tmp_path)}, cols, train)
    R.stored("test-clusters", rows, {"k": 2, "run": str(tmp_path)}, cols[:2], train)
    assert len(made) == 4


_SECOND = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from wicketlake.ml import models as M, registry as R
from pyspark.sql import functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
rows = spark.range(40).select(F.col("id").alias("player_name"), (F.col("id") % 7).cast("double").alias("x1"))
def train():
    print("TRAINED")
    return M.cluster_players(rows, ["x1"], k=2, starts=1, max_iter=5)[0]
model = R.stored("second", rows, {{"k": 2}}, ["x1"], train)
print("SCORED", model.transform(rows).count())
"""


def test_a_second_application_scores_without_training(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = _SECOND.format(root=root, shared=f"file://{tmp_path}/shared")
    out = [subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout for _ in range(2)]
    assert "TRAINED" in out[0] and "SCORED 40" in out[0]
    assert "TRAINED" not in out[1] and "SCORED 40" in out[1]


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    (tmp_path / "t.parquet" / "x.parquet").write_bytes(b"not parquet")
    listed = versioned.files_at(spark, str(tmp_path / "t.parquet")).collect()
    assert [(r.number) for r in listed] == [11]
