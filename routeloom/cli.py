"""Command line: make a fixture, run the experiment, or decide one request."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from routeloom.learning.artifact import load_artifact
from routeloom.plans.experiment import run_experiment
from routeloom.sources.config import read_config
from routeloom.sources.fixtures import write_dataset
from routeloom.sources.history import load_sealed
from routeloom.sources.sealed import current


def _show(spark: SparkSession, path: str, query: str) -> None:
    artifact = load_artifact(spark, path)
    decision = artifact.decide(spark.createDataFrame([(query,)], "query string")).first()["decision"]
    print(f"Query: {query}\nquality threshold {artifact.predictor.training.quality_score_threshold}, probability threshold {artifact.policy.router_probability_threshold}, cost tolerance {artifact.policy.cost_tolerance_abs}")
    for e in decision["candidate_estimates"]:
        print(f"{e['model_id']:20} p {e['pass_probability']:.6f}  cost {e['estimated_cost']:.8f}  latency {e['estimated_latency_ms']:.3f} ms")
    print(f"Qualified: {', '.join(decision['qualified_models']) or '(none)'}\nSelected: {decision['selected_model']} ({decision['decision_reason']})")
    if decision["fallback_used"]:
        print("No model reaches the probability threshold; the likeliest was taken.")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="routeloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("make-data", "experiment"):
        one = sub.add_parser(name)
        one.add_argument("--config", required=True)
        one.add_argument("--root", required=True, help="folder of the data set")
        if name == "experiment":
            one.add_argument("--output", required=True)
    one = sub.add_parser("decide")
    one.add_argument("--artifact", required=True)
    one.add_argument("--query", help="asked for if left out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("routeloom").getOrCreate()
    try:
        if given.command == "decide":
            _show(spark, given.artifact, given.query if given.query is not None else input("Query: "))
        elif given.command == "make-data":
            print(write_dataset(spark, read_config(given.config), given.root))
        else:
            config, folder = read_config(given.config), current(spark, given.root)
            history, manifest = load_sealed(spark, folder, [m["model_id"] for m in config["models"]])
            report = run_experiment(spark, history, config, manifest, given.output)
            print(json.dumps({name: values["metrics"] for name, values in report["held_out"]["test"]["policies"].items()}, ensure_ascii=False, indent=2))
    except (ValueError, EOFError) as error:
        parser.error(str(error))


if __name__ == "__main__":
    main()
