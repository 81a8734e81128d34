"""Command line: ``spark-submit`` entry points for the jobs.

    python -m pricetide prepare --raw transactions.parquet --out data
    python -m pricetide train --data data --model model
    python -m pricetide quality|noise|series --data data --model model --reports reports
    python -m pricetide policies --data data --model model --reports reports
    python -m pricetide products --data data --model model --reports reports
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import replace

from .config import Settings
from .plans import evaluation, preparation
from .session import build_session
from .sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pricetide", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)

    prepare = commands.add_parser("prepare", help="transactions or a daily panel to scaled splits")
    source = prepare.add_mutually_exclusive_group(required=True)
    source.add_argument("--raw", help="raw transactions (parquet)")
    source.add_argument("--panel", help="pre-aggregated daily panel (parquet)")
    prepare.add_argument("--out", required=True)
    prepare.add_argument("--grain", default="day", choices=("day", "week", "month"))
    prepare.add_argument("--top-n", type=int, default=Settings.top_n)

    train = commands.add_parser("train", help="fit the demand model")
    train.add_argument("--trees", type=int, default=Settings.n_trees)
    series = commands.add_parser("series", help="actual and predicted units of one product")
    series.add_argument("--product")
    quality = commands.add_parser("quality", help="R squared, MAE and RMSE on the test split")
    noise = commands.add_parser("noise", help="residual deviation on the validation split")
    policies = commands.add_parser("policies", help="backtest policies and report KPIs")
    policies.add_argument("--num-products", type=int)
    policies.add_argument("--bootstraps", type=int, default=Settings.bootstraps)
    products = commands.add_parser("products", help="evaluate per product against historical prices")
    products.add_argument("--episodes", type=int, default=1)
    products.add_argument("--product-ids", default="", help="comma-separated")
    products.add_argument("--align", default="position", choices=("position", "date"))
    for command in (train, series, quality, noise, policies, products):
        command.add_argument("--data", required=True)
        command.add_argument("--model", required=True)
    for command in (series, quality, noise, policies, products):
        command.add_argument("--reports", required=True, help="folder that the whole results are written to")
    for command in (policies, products):
        command.add_argument("--noise-std", type=float, default=Settings.noise_std)
        command.add_argument("--cost-ratio", type=float, default=Settings.cost_ratio)
    for command in (prepare, policies):
        command.add_argument("--train-end", type=dt.date.fromisoformat, default=Settings.train_end)
        command.add_argument("--val-end", type=dt.date.fromisoformat, default=Settings.val_end)
    return p


def write_report(result, folder: str, name: str) -> None:
    """Write every row of a result as CSV and show its first rows."""
    tables.write_csv_report(result, f"{folder}/{name}")
    result.show()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session(f"pricetide {args.command}")
    overrides = {k: v for k, v in vars(args).items() if k in Settings.__dataclass_fields__}
    settings = replace(Settings(), **overrides)
    if args.command == "prepare":
        preparation.prepare_data(spark, args.out, args.raw, args.panel, settings, args.grain)
    elif args.command == "train":
        evaluation.train_demand(spark, args.data, args.model, settings, args.trees)
    elif args.command == "series":
        write_report(evaluation.demand_series(spark, args.data, args.model, args.product), args.reports, "series")
    elif args.command == "quality":
        write_report(evaluation.evaluate_demand(spark, args.data, args.model), args.reports, "quality")
    elif args.command == "noise":
        write_report(evaluation.calibrate_noise(spark, args.data, args.model), args.reports, "noise")
    elif args.command == "policies":
        evaluation.run_full_evaluation(spark, args.data, args.model, args.reports, settings, args.num_products,
                                       args.bootstraps).show(truncate=False)
    else:
        ids = [p.strip() for p in args.product_ids.split(",") if p.strip()]
        _, portfolio = evaluation.evaluate_products(spark, args.data, args.model, args.reports, settings,
                                                    args.episodes, ids, args.align)
        portfolio.show(truncate=False)


if __name__ == "__main__":
    main()
