import os
import tempfile

import pytest
from pyspark.sql import functions as F

from revisit.schemas import SEQ_SCHEMA, VIDEO_CCID_SCHEMA
from revisit.sources import io


def _tmp():
    return tempfile.mkdtemp(prefix="revisit-test-")


def test_json_tsv_parquet_csv_roundtrip(spark):
    d = _tmp()
    with open(f"{d}/uv.json", "w") as f:
        f.write('{"user_id": "U_1", "seq": [{"video_id": "V_1", "segment": [{"end_point": 394.9, '
                '"start_point": 294.9, "speed": 1.25, "local_start_time": 100}]}]}\n')
        f.write('{"user_id": "U_2", "seq": []}\n')
    uv = io.read_json(spark, f"{d}/uv.json")
    assert uv.schema == SEQ_SCHEMA and uv.count() == 2
    with open(f"{d}/map.txt", "w") as f:
        f.write("V_1\tC1\nV_2\tC2\n")
    m = io.read_tsv(spark, f"{d}/map.txt")
    assert m.schema == VIDEO_CCID_SCHEMA and m.count() == 2
    io.write_parquet(uv, f"{d}/uv.parquet")
    assert io.read_parquet(spark, f"{d}/uv.parquet").count() == 2
    assert any(n.endswith(".gz.parquet") for n in os.listdir(f"{d}/uv.parquet"))
    io.write_csv(m.select("video_id"), f"{d}/csv")
    assert spark.read.option("header", "true").csv(f"{d}/csv").columns == ["video_id"]


def test_conform_reorders_nested_fields_and_rejects_mismatch(spark):
    df = spark.createDataFrame(
        [("U", [("s", [(1.0, 2.0, 1.0, 3)])])],
        "user_id string, seq array<struct<video_id:string, segment:array<struct<start_point:double, "
        "end_point:double, speed:double, local_start_time:bigint>>>>")
    c = io.conform(df, SEQ_SCHEMA)
    assert c.schema == SEQ_SCHEMA
    seg = c.collect()[0]["seq"][0]["segment"][0]
    assert seg["start_point"] == 1.0 and seg["end_point"] == 2.0
    bad = spark.createDataFrame([("U", 1)], "user_id string, seq int")
    with pytest.raises(TypeError):
        io.conform(bad, SEQ_SCHEMA)


def test_partition_by_user_one_file_per_user(spark):
    d = _tmp()
    df = spark.range(200).select((F.col("id") % 17).cast("string").alias("user_id"), "id")
    io.partition_by_user(df, 5).write.parquet(f"{d}/p")
    files = [f for f in os.listdir(f"{d}/p") if f.endswith(".parquet")]
    seen = {}
    for f in files:
        for r in spark.read.parquet(f"{d}/p/{f}").select("user_id").distinct().collect():
            assert r[0] not in seen
            seen[r[0]] = f
    assert len(seen) == 17


def test_line_aligned_dictionary(spark):
    d = _tmp()
    with open(f"{d}/a.txt", "w") as f:
        f.write("\n".join(f"zh{i}" for i in range(81)) + "\n")
    with open(f"{d}/b.txt", "w") as f:
        f.write("\n".join(f"en{i}" for i in range(81)) + "\n")
    t = io.read_line_aligned(spark, f"{d}/a.txt", f"{d}/b.txt")
    rows = t.collect()
    assert len(rows) == 81 and all(r["field_zh"][2:] == r["field_en"][2:] for r in rows)


def test_bucketed_table_needs_no_shuffle_for_user_aggregates(spark):
    name = f"revisit_bucketed_{os.getpid()}"
    df = spark.range(1000).select((F.col("id") % 37).alias("user_id"), "id")
    io.write_bucketed(df, name, n=4)
    try:
        t = spark.table(name)
        agg = t.groupBy("user_id").agg(F.count("*").alias("n"))
        plan = agg._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert agg.count() == 37
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_rebalance(spark):
    df = spark.range(100, numPartitions=3)
    assert io.rebalance(df, 7).rdd.getNumPartitions() == 7 and io.rebalance(df, 7).count() == 100
    assert io.rebalance(df, 2, shuffle=False).rdd.getNumPartitions() == 2


def test_line_numbers_do_not_depend_on_splits(spark):
    """Several files and tiny splits: numbers follow the files' order and lines."""
    d = _tmp()
    os.makedirs(f"{d}/a")
    lines = [f"zh {i} " + "x" * (i % 50) for i in range(3000)]
    for k in range(3):
        with open(f"{d}/a/{k}.txt", "w") as f:
            f.write("\n".join(lines[k * 1000:(k + 1) * 1000]) + "\n")
    with open(f"{d}/b.txt", "w") as f:
        f.write("\r\n".join(f"en {i}" for i in range(3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(f"{d}/b.txt").rdd.getNumPartitions() > 5  # several splits of one file
        both = io.read_line_aligned(spark, f"{d}/a", f"{d}/b.txt")
        rows = both.collect()
        assert both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan text") == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {r.line: (r.field_zh, r.field_en) for r in rows}
    assert got == {i: (lines[i] if i < 3000 else None, f"en {i}") for i in range(3001)}


def test_lines_of_odd_files(spark):
    """Empty files have no lines; blank lines, long lines and a missing last line end count."""
    d = _tmp()
    texts = {"0": "", "1": "a\n\n\r\nb", "2": "\n", "3": "é" * 50_000 + "\nlast\n"}
    for k, t in texts.items():
        with open(f"{d}/{k}.txt", "w", newline="") as f:
            f.write(t)
    got = [(r.line, r.x) for r in io.read_lines(spark, d, "x").orderBy("line").collect()]
    assert got == list(enumerate(["a", "", "", "b", "", "é" * 50_000, "last"]))
    os.makedirs(f"{d}/none")
    open(f"{d}/none/e.txt", "w").close()
    assert io.read_lines(spark, f"{d}/none", "x").collect() == []


def test_large_parts_are_sliced(spark, monkeypatch):
    """A task sorts a bounded number of rows; a part keeps its users and each user one sorted file."""
    from revisit.plans import pipelines
    seqs = [(str(u), [("v", [(1.0, 0.0, 1.0, t) for t in range(3)])] * 5) for u in range(40)] + [("x", []), ("y", None), ("z", [("v", None)])]
    df = spark.createDataFrame(seqs, SEQ_SCHEMA)
    assert io.user_slices(df, 4, 10**6) == 1 and io.user_slices(df.limit(0), 4, 1) == 1
    assert io.user_slices(df, 4, 100) == 3  # 43 rows, 201 elements, 600 segments
    rows = df.select("user_id", F.explode_outer("seq").alias("seq"), F.lit("v").alias("video_id"), F.lit("c").alias("ccid"))
    assert io.user_slices(rows, 4, 100) == 3  # 203 rows, 600 segments
    place = lambda d: {r.user_id: r.p for r in d.select("user_id", F.spark_partition_id().alias("p")).distinct().collect()}
    whole, cut = place(io.partition_by_user(df, 4)), place(io.partition_by_user(df, 4, slices=3))
    assert whole == {u: p % 4 for u, p in cut.items()} and max(cut.values()) > 3
    monkeypatch.setattr(io, "user_slices", lambda d, n: 3)
    d = _tmp()
    pipelines.layout_by_user(df, f"{d}/p", 4)
    files = [f"{d}/p/{f}" for f in os.listdir(f"{d}/p") if f.endswith(".parquet")]
    users = [[r.user_id for r in spark.read.parquet(f).select("user_id").collect()] for f in files]
    assert len(files) > 4 and all(u == sorted(u) for u in users) and sorted(sum(users, [])) == sorted(u for u, _ in seqs)
