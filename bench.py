"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pairs_within_cutoff", "pair_energy_lj", "pair_energy_lj_ewald_switch", "pair_energy_table", "pair_forces", "nonbonded_excluding",
    "bond_forces", "angle_forces", "dihedral_forces", "integrate_step", "dpd_forces", "shake_step", "cell_counts", "temperature", "molecular_temperature",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from lattica.plans import queries

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    n_pairs = 0
    queries.cell_counts(spark, sf).collect()  # compile and open files once
    for name in HEADLINE:
        began = time.time()
        df = queries.QUERIES[name](spark, sf)
        if name == "pairs_within_cutoff":
            n_pairs = sum(r["n"] for r in df.collect())
        else:
            df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    value = round(sum(took.values()), 3)
    print(json.dumps({"metric": "total time of the headline particle queries", "value": value, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "pairs": n_pairs, "pairs_per_sec": round(n_pairs / took["pairs_within_cutoff"]), "seconds_per_step": took["integrate_step"]}))


if __name__ == "__main__":
    main()
