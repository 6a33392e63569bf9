"""Replicated scale run: the name pipeline and the sampling operators on a
register of about 6.3 M licences (the reference's full data size).

The register is the sf0.1 licence view replicated 42 times (each copy gets
its own id range; names, dates and regions repeat), so it is derived from
the given tables.  Each step runs in full through the ``noop`` sink.

Usage: python tests/scale_run.py [sf_dir] [copies]
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    from pyspark.sql import functions as F

    from bizlens.operators import features as feat
    from bizlens.operators import names as nm
    from bizlens.operators import sampling as sp
    from bizlens.session import local_session
    from bizlens.sources.licences import licences

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    copies = int(argv[2]) if len(argv) > 2 else 42
    spark = local_session(shuffle_partitions=64, driver_memory="16g", app="bizlens-scale")
    spark.sparkContext.setLogLevel("OFF")
    base = licences(spark, sf)
    span = base.agg(F.max("unique_id")).first()[0] + 1
    big = (base.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"))
           .withColumn("unique_id", F.col("unique_id") + F.col("_copy") * F.lit(span)).drop("_copy")
           .repartition(64, "unique_id"))
    out = {}

    def run(name, df):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out[name] = round(time.perf_counter() - t, 2)
        print(name, out[name], flush=True)

    rows = big.count()
    names = nm.final_name_table(big, top_n=500, min_freq=500)
    run("final_name_table", names)
    run("franchise_flag", feat.franchise_flag(names, 20))
    spark.catalog.clearCache()
    small = big.select("unique_id", "service", "closed")
    run("stratified_split", sp.stratified_split(small, ["service", "closed"], 0.1, "unique_id", 42))
    run("sample_to_1M", sp.sample_to(small, ["closed"], 1_000_000, "unique_id", 43).where("sampled"))
    run("oversample_keep", sp.oversample(small, "closed", "unique_id", 43, keep_originals=True))
    print(json.dumps({"rows": rows, "seconds": out}))


if __name__ == "__main__":
    main(sys.argv)
