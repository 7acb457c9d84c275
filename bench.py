"""Time the headline queries; prints one JSON line.

``render`` writes the tables as EDI text. ``ingest`` goes from that text to the committed store.
``feature_fit`` learns dictionaries and threshold. The other queries then read the store.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from starcheck import queries as star

HEADLINE = ("segments_archive", "ingest_summary", "claims", "list_claims", "claim_detail",
            "claim_tree", "denials", "code_lookup", "resolution", "dataset", "dataset_stats",
            "label_dictionary", "charge_threshold", "features")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("remitframe-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    def run(df):
        df.write.format("noop").mode("overwrite").save()
    text = []
    timed("render", lambda: text.append(star.render(spark, sf_dir)))
    timed("ingest", lambda: star.star_store(spark, sf_dir, text[0]))
    timed("feature_fit", lambda: star.star_model(spark, sf_dir))
    registered = star.queries()
    for name in HEADLINE:
        timed(name, lambda name=name: run(registered[name](spark, sf_dir)))
    segments = star.star_store(spark, sf_dir).read("raw_segments").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "segments": segments, "segments_per_sec": round(segments / times["ingest"])}))
    spark.stop()


if __name__ == "__main__":
    main()
