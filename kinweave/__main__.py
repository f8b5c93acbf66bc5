"""Command line: python -m kinweave --output DIR [--input DIR] [--incremental | --review FILE | --evaluate | --calibrate]"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from dataclasses import replace
from functools import partial

from kinweave.streaming.progress import setup_logging


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinweave", description="Group the faces of a photo collection by person.")
    p.add_argument("--input", "-i")
    p.add_argument("--output", "-o")
    p.add_argument("--config", "-c", default="config.yaml")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--review", metavar="JSON", help="corrections to learn from: an object of face ids and labels")
    p.add_argument("--evaluate", action="store_true")
    p.add_argument("--ground-truth")
    p.add_argument("--calibrate", action="store_true")
    p.add_argument("--detector", help="module:factory of a face detector, or an .onnx file of one with anchors (see OnnxDetector)")
    p.add_argument("--embedder", help="module:factory of an embedding model, or an .onnx file of one")
    args = p.parse_args(argv)
    if (args.evaluate or args.calibrate) and not args.ground_truth or not (args.evaluate or args.calibrate or args.review) and not args.input or not args.output:
        p.print_usage(sys.stderr)
        return 1
    setup_logging(f"{args.output}/_logs" if "://" not in args.output else None)

    from pyspark.sql import SparkSession

    from kinweave.operators.evaluate import report_text
    from kinweave.operators.imaging import MeanColorEmbedder, OnnxDetector, OnnxEmbedder
    from kinweave.plans.engine import Engine
    from kinweave.sources.config import load
    from kinweave.sources.tables import load_ground_truth

    config = load(args.config)
    config = replace(config, input_dir=args.input or config.input_dir, output_dir=args.output)
    factory = lambda name, model: partial(model, name) if name.endswith(".onnx") else getattr(importlib.import_module(name.split(":")[0]), name.split(":")[1])
    spark = SparkSession.builder.appName("kinweave").getOrCreate()
    engine = Engine(spark, config, factory(args.detector, OnnxDetector) if args.detector else None, factory(args.embedder, OnnxEmbedder) if args.embedder else MeanColorEmbedder)
    if args.evaluate:
        print(report_text(engine.evaluate(args.ground_truth)).first()["text"])
    elif args.calibrate:
        found = engine.calibrate(args.ground_truth)
        found.show(truncate=False)
        for r in found.filter("best").collect():
            print(f"best: min_cluster_size={r['min_cluster_size']} min_samples={r['min_samples']} (f1={r['f1']:.4f})")
    elif args.review:
        given = load_ground_truth(spark, args.review).selectExpr("key as face_id", "gt_label as label", "unix_micros(current_timestamp()) as seq")
        engine.correct(given)
        engine.learn()
    else:
        engine.run(args.incremental)
        print(json.dumps(engine.copy_files() | engine.counts))
        print(engine.status())
    return 0


if __name__ == "__main__":
    sys.exit(main())
