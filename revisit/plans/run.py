"""Command line for the pipelines (the reference's scripts as Spark jobs).

    python -m revisit.plans.run clean      --sequences uv.json --video-ccid video_id-ccid.txt --out DIR [--thresh 20]
    python -m revisit.plans.run partition  --sequences DIR/clean --out DIR [--parts 30]
    python -m revisit.plans.run sessions   --sequences parts/ --out DIR [--session-thresh 3600]
    python -m revisit.plans.run lectures   --events events.parquet --out DIR
    python -m revisit.plans.run courses    --courses course_ext.parquet --out DIR [--mode as_written|intent]
    python -m revisit.plans.run recommend  --counts counts.parquet --out DIR
    python -m revisit.plans.run confidence --counts counts.parquet --out DIR

Inputs are read with the reference schemas (JSON sequences, headerless TSV maps,
Parquet otherwise). On a cluster, run it with spark-submit; the session comes
from the cluster configuration and ``spark.checkpoint.dir`` must name a shared
folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from revisit.plans import pipelines
from revisit.session import ensure_checkpoint_dir, prepare
from revisit.sources import io


def _sequences(spark, path):
    """Sequences: JSON lines (``*.json`` file or folder) or Parquet (raw lists, or P-1's or
    P-2's table)."""
    return io.read_json(spark, path) if path.rstrip("/").endswith(".json") else io.read_parquet(spark, path)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="revisit")
    ap.add_argument("pipeline", choices=["clean", "partition", "sessions", "lectures", "courses",
                                         "recommend", "confidence"])
    ap.add_argument("--sequences")
    ap.add_argument("--video-ccid")
    ap.add_argument("--events")
    ap.add_argument("--courses")
    ap.add_argument("--counts")
    ap.add_argument("--out", required=True)
    ap.add_argument("--thresh", type=int, default=20)
    ap.add_argument("--parts", type=int, default=30)
    ap.add_argument("--session-thresh", type=float, default=3600)
    ap.add_argument("--mode", default="as_written")
    a = ap.parse_args(argv)

    spark = prepare(SparkSession.builder.appName(f"revisit-{a.pipeline}").getOrCreate())
    ensure_checkpoint_dir(spark)
    if a.pipeline == "clean":
        res = pipelines.clean_repeaters(_sequences(spark, a.sequences), io.read_tsv(spark, a.video_ccid),
                                        a.out, rep_thresh=a.thresh)
        io.write_parquet(res.report, f"{a.out}/report", compression=None)
    elif a.pipeline == "partition":
        pipelines.layout_by_user(_sequences(spark, a.sequences), a.out, a.parts)
    elif a.pipeline == "sessions":
        segs = pipelines.to_segments(_sequences(spark, a.sequences), a.out)
        pipelines.session_repetition(segs, a.out, session_thresh=a.session_thresh,
                                     tie=("src_row", "seq_pos", "seg_pos"))
    elif a.pipeline == "lectures":
        pipelines.lecture_sequences(io.read_parquet(spark, a.events), a.out)
    elif a.pipeline == "courses":
        io.write_parquet(pipelines.courses_alternating_videos(io.read_parquet(spark, a.courses), a.mode),
                         f"{a.out}/courses_alternating_videos")
    elif a.pipeline == "recommend":
        res = pipelines.rewatch_recommendation(io.read_parquet(spark, a.counts), a.out)
        io.write_parquet(res["means"], f"{a.out}/means", compression=None)
    else:
        io.write_parquet(pipelines.rewatch_confidence(io.read_parquet(spark, a.counts), a.out),
                         f"{a.out}/confidence")


if __name__ == "__main__":
    main()
