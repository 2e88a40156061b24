"""Hot-user check: sessionize with time-bucket chunks vs whole-user windows.

Derives a skewed segment table from the given events (a third of all rows
moved to one user, the table repeated ``REPEAT`` times with shifted times) and
times ``sessionize`` with day chunks and with one chunk per user; both results
are compared. Usage: python tools/skew_check.py [sf_dir] [repeat]
"""

from __future__ import annotations

import sys
import time
import uuid

sys.path.insert(0, ".")

from pyspark.sql import functions as F  # noqa: E402

from revisit.operators import sequences  # noqa: E402
from revisit.session import build_session, ensure_checkpoint_dir  # noqa: E402
from revisit.sources import views  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    rep = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    spark = build_session()
    seg = views.seg_view(spark, sf)
    span = seg.agg(F.max("local_start_time") - F.min("local_start_time") + 1).first()[0]
    skewed = (seg.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rep - 1))))
              .select((F.col("seg_id") * rep + F.col("r")).alias("seg_id"),
                      F.when(F.col("seg_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).alias("user_id"),
                      "video_id", (F.col("local_start_time") + F.col("r") * span).alias("local_start_time"),
                      "start_point", "end_point", "speed"))
    path = f"{ensure_checkpoint_dir(spark)}/skew-segments-{uuid.uuid4().hex}"
    skewed.write.parquet(path)
    s = spark.read.parquet(path)
    print("rows", s.count(), "hot user rows", s.filter("user_id = 0").count())
    out = {}
    for label, bucket in (("chunked_day", 86400), ("whole_user", 10 ** 12)):
        df = sequences.sessionize(s, bucket_seconds=bucket)
        df.write.format("noop").mode("overwrite").save()
        t0 = time.time()
        df.write.format("noop").mode("overwrite").save()
        out[label] = round(time.time() - t0, 2)
    a = sequences.sessionize(s).select(F.sum(F.hash("seg_id", "video_consecutive_id", "gap", "session_id")))
    b = sequences.sessionize(s, bucket_seconds=10 ** 12).select(
        F.sum(F.hash("seg_id", "video_consecutive_id", "gap", "session_id")))
    print(out, "same result:", a.first()[0] == b.first()[0])


if __name__ == "__main__":
    main()
