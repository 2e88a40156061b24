import itertools
import zlib

from pyspark.sql import functions as F

from revisit.llm import hilbert

SCHEMA = "doc_id long, text string, lang string, source string"


def curve(spark, n, bits):
    grid = spark.createDataFrame(list(itertools.product(range(2 ** bits), repeat=n)), ", ".join(f"a{i} int" for i in range(n)))
    axes = [F.col(f"a{i}") for i in range(n)]
    return sorted((r[-1], *r[:-1]) for r in grid.select(*axes, hilbert.curve_index(axes, bits)).collect())


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 1), (2, 3), (3, 2), (3, 3), (1, 3)):
        path = curve(spark, n, bits)
        assert [p[0] for p in path] == list(range(2 ** (n * bits)))
        for a, b in itertools.pairwise(path):
            assert sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1


def laws(rows, data, shards):
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((d[0] is not None, d[0] or 0) for d in data)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((d[0] is not None, d[0] or 0, len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in data)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hilbert.hilbert_shards(docs)
    rows = out.collect()
    laws(rows, [(r.doc_id, r.text) for r in docs.collect()], 16)
    # Runs of the curve: shards do not overlap on it.
    spans = {}
    for r in rows:
        lo, hi = spans.get(r.shard, (r.curve, r.curve))
        spans[r.shard] = (min(lo, r.curve), max(hi, r.curve))
    assert all(spans[s][1] <= spans[s + 1][0] for s in range(15))


def test_shards_prune(spark):
    """A filter on language or source meets fewer shards than with shards by hash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = hilbert.hilbert_shards(docs).select("doc_id", "shard").join(docs, "doc_id").withColumn(
        "hashed", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    met = lambda shard: sum(out.select(shard, c).distinct().count() for c in ("lang", "source"))
    assert met("shard") < 0.75 * met("hashed")


def test_odd_rows(rows):
    data = [(None, None, None, None), (1, "", "en", None), (1, "", "en", None), (2, "é" * 500, None, "s"), *[(10 + i, "same", "en", "s") for i in range(37)]]
    df = rows(data, SCHEMA).withColumn("shard", F.lit(9)).withColumn("curve", F.lit("x")).withColumn("size", F.lit(None))
    laws(hilbert.hilbert_shards(df).collect(), data, 16)
    few = [(1, "a", "en", "s"), (2, "b", "en", "s")]
    laws(hilbert.hilbert_shards(rows(few, SCHEMA)).collect(), few, 16)
    assert hilbert.hilbert_shards(rows([], SCHEMA)).collect() == []


def test_written_files_prune(spark, tmp_path):
    """Files hold the documents, and their minima and maxima rule most of them out."""
    import glob

    import pyarrow.parquet as pq
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hilbert.write_shards(docs, str(tmp_path / "out"), files=48)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    files = glob.glob(f"{tmp_path}/out/shard=*/*.parquet")
    met = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        stats = {n: meta.row_group(0).column(names.index(n)).statistics for n in ("lang", "source")}
        met += stats["lang"].min <= "fr" <= stats["lang"].max and stats["source"].min <= "src5" <= stats["source"].max
    assert len(files) >= 48 and met < 0.4 * len(files)


def test_cuts_of_strings_follow_whole_values(rows):
    """Cells of about equal numbers of rows, whatever prefix the values share."""
    site = lambda i: f"https://www.example.org/site{i:03d}"
    data = [(i, "x", "en", site(i % 200)) for i in range(2000)]
    cuts = hilbert.cut_strings(rows(data, SCHEMA), "source", 4)
    ordered = sorted(d[3] for d in data)
    assert len(cuts) == 15
    cells = [sum(c <= s for c in cuts) for s in ordered]
    assert set(cells) == set(range(16)) and max(map(cells.count, range(16))) <= 2000 / 16 + 10
    # One value with two thirds of the rows, and fewer values than cells.
    hot = [(i, "x", "en", "b" if i % 3 else "ac"[i % 2]) for i in range(300)]
    assert hilbert.cut_strings(rows(hot, SCHEMA), "source", 4) == ["b", "c"]
    assert hilbert.cut_strings(rows([], SCHEMA), "source", 4) == []


def test_shards_prune_sources_with_a_long_common_prefix(spark, rows):
    """200 sources that share 20 bytes: a shard holds few of them."""
    data = [(i, "t" * (i * 37 % 1000), ("en", "fr")[i % 2], f"https://www.example.org/site{i % 200:03d}") for i in range(4000)]
    df = rows(data, SCHEMA)
    out = hilbert.hilbert_shards(df).join(df, "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert len(out) == 16 and sum(r.n for r in out) / 16 < 0.4 * 200
