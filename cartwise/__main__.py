"""Command line: ``python -m cartwise run|prepare|model|recommend --out DIR``.

``run`` does all three jobs; each of the others reads what the one before it
wrote below ``--out``.  On a local session (a cluster job would submit the
functions of ``cartwise.plans.pipeline`` with its own session).
"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cartwise")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("run", "prepare", "model", "recommend"):
        p = sub.add_parser(name)
        p.add_argument("--out", required=True, help="folder for the results")
        p.add_argument("--cores", default="*")
        if name in ("run", "prepare"):
            source = p.add_mutually_exclusive_group(required=True)
            source.add_argument("--sf", help="folder of Parquet source tables")
            source.add_argument("--csv", help="folder of the nine CSV files")
            p.add_argument("--prefix", default="", help="of the CSV files' names")
            p.add_argument("--suffix", default=".csv")
            p.add_argument("--translation", help="file name of product_translation")
            p.add_argument("--n-purchase", type=int, help="joined rows of a cohort customer")
        if name in ("run", "model"):
            p.add_argument("--select-best", action="store_true",
                           help="train the final model with the best C of the grid")
        if name in ("run", "recommend"):
            p.add_argument("--sample-size", type=int, default=5)
            p.add_argument("--product-number", type=int, default=5)
            p.add_argument("--verbose", action="store_true")
    args = ap.parse_args(argv)

    from cartwise.plans import pipeline
    from cartwise.session import local_session
    from cartwise.sources.retail_csv import load_csv_tables
    from cartwise.sources.retail_view import retail_tables

    spark = local_session(args.cores)
    if args.cmd in ("run", "prepare"):
        if args.csv:
            names = {"product_translation": args.translation} if args.translation else None
            t = load_csv_tables(spark, args.csv, args.prefix, args.suffix, names)
        else:
            t = retail_tables(spark, args.sf)
        n = args.n_purchase or (2 if args.csv else pipeline.DEFAULT_N_PURCHASE)
        pipeline.prepare(spark, t, args.out, n)
    if args.cmd in ("run", "model"):
        pipeline.model(spark, args.out, args.select_best)
    if args.cmd in ("run", "recommend"):
        paths = pipeline.recommend(spark, args.out, args.sample_size, args.product_number,
                                   verbose=args.verbose)
        report = spark.read.parquet(paths["report"]).orderBy("customer_unique_id", "line_no")
        for row in report.toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
