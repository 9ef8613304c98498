"""Batch retrain job (the reference's weekly retrain script, as a Spark job).

bars -> period limit -> minimum history -> core indicators -> 30-bar label -> usable rows
-> per-ticker embargo split -> SAMME fit (100 rounds) -> evaluation -> model save ->
new run-log version. Prints the metrics record as one JSON line and exits 1 on failure.

    spark-submit -m pricelens.plans.retrain --sf /data/tables            (test tables)
    python -m pricelens.plans.retrain --bars /data/bars --format parquet  (landed bars)
        [--master local[8]] [--years 10] [--rounds 100] [--out DIR]

Model and log go under ``--out``, by default ``<spark.checkpoint.dir>/retrain``.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import json
import os
import sys

from pyspark.sql import functions as F


def run(spark, sf_dir: str | None = None, bars_path: str | None = None, fmt: str = "parquet",
        years: int = 10, rounds: int = 100, out: str | None = None, label_mode: str = "strict"):
    from pricelens.operators import indicators as I
    from pricelens.operators import labels as L
    from pricelens.operators import training as T
    from pricelens.operators.windows import prepare
    from pricelens.session import ensure_checkpoint_dir
    from pricelens.sources import derived as D
    from pricelens.sources.bars import read_bars, restrict_period

    if (sf_dir is None) == (bars_path is None):
        raise ValueError("give exactly one of sf_dir / bars_path")
    bars = D.bars(spark, sf_dir) if sf_dir else read_bars(spark, bars_path, fmt)
    universe = (D.universe(spark, sf_dir) if sf_dir
                else bars.select("sector", "ticker").distinct())
    bars = L.min_history(restrict_period(bars, years), 200)
    split = L.embargo_split(L.usable_rows(
        I.add_label(I.indicators_core(prepare(bars)), 30, label_mode)))
    rows = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    out = out or os.path.join(ensure_checkpoint_dir(spark), "retrain")
    stamp = _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    model, rec = T.train_run(split, universe, rows, rounds=rounds,
                             save_to=os.path.join(out, "models", stamp),
                             log_path=os.path.join(out, "log"))
    return model, rec


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf", help="folder of the test tables (bars derived from lineitem)")
    src.add_argument("--bars", help="folder of landed bars")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    ap.add_argument("--master", help="local master for a run outside spark-submit")
    ap.add_argument("--years", type=int, default=10)
    ap.add_argument("--rounds", type=int, default=100)
    ap.add_argument("--label-mode", default="strict", choices=["strict", "compat"])
    ap.add_argument("--out")
    a = ap.parse_args(argv)
    if a.master:
        from pricelens.session import get_session
        spark = get_session(master=a.master)
    else:
        from pyspark.sql import SparkSession
        from pricelens.session import ensure_checkpoint_dir
        spark = SparkSession.builder.appName("pricelens-retrain").getOrCreate()
        ensure_checkpoint_dir(spark)
    try:
        _, rec = run(spark, a.sf, a.bars, a.format, a.years, a.rounds, a.out, a.label_mode)
        print(json.dumps(json.loads(rec.toJSON().first()), sort_keys=True))
        return 0
    except Exception as e:  # the job's exit status is its contract with the scheduler
        print(f"retrain failed: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
