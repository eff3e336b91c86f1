"""Command line: partition, generate."""

from __future__ import annotations

import argparse
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pinloom.operators.metrics import quality_report
from pinloom.options import Options
from pinloom.plans.recursive import partition
from pinloom.sources.export import result_path, write_partition
from pinloom.sources.mtx import random_pins, read_header, read_hypergraph, write_matrix


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="pinloom")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("partition", help="split a matrix's columns and write the partition")
    run.add_argument("file")
    run.add_argument("--config", help="TOML file; options given here override it")
    run.add_argument("--results", default="results")
    for name, kind in (("k", int), ("eps", float), ("eta", float), ("seed", int), ("sample_size", int), ("max_cluster_size", int), ("lp_max_iter", int), ("coarsening_nrvertices", int), ("coarsening_max_rounds", int), ("klfm_max_passes", int), ("klfm_max_no_gain_moves", int), ("klfm_par_send_moves", int), ("restarts", int), ("kernel_max_pins", int), ("weights", str), ("metric", str), ("bisect", str), ("sampling", str)):
        run.add_argument(f"--{name.replace('_', '-')}", dest=name, type=kind)
    make = commands.add_parser("generate", help="write a random matrix")
    for name in ("nets", "vertices", "pins"):
        make.add_argument(name, type=int)
    make.add_argument("file")
    make.add_argument("--seed", type=int, default=1)
    args = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("pinloom").getOrCreate()
    command, file = args.pop("command"), args.pop("file")
    if command == "generate":
        write_matrix(random_pins(spark, args["nets"], args["vertices"], args["pins"], args["seed"]), args["nets"], args["vertices"], file)
        return
    results, config = Path(args.pop("results")), args.pop("config")
    options = Options.load(config, **args)
    results.mkdir(parents=True, exist_ok=True)
    (results / "settings.toml").write_text(options.to_toml())
    _, _, nets, vertices, _, _ = read_header(file)
    h = read_hypergraph(spark, file, options.weights)
    began = time.perf_counter()
    labels = partition(h, options)
    took = time.perf_counter() - began
    write_partition(h.pins, labels, options.k, nets, vertices, result_path(results, file, options.k))
    quality_report(h.labelled(labels), options.k).withColumn("seconds", F.lit(round(took, 3))).show(truncate=False)


if __name__ == "__main__":
    main()
