"""python -m sieve parse FILE | classify FILE --model DIR | model-info DIR | evaluate SCORES.parquet [--fpr X]."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sieve")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("parse").add_argument("file")
    c = sub.add_parser("classify")
    c.add_argument("file")
    c.add_argument("--model", required=True)
    sub.add_parser("model-info").add_argument("model")
    e = sub.add_parser("evaluate")
    e.add_argument("scores")
    e.add_argument("--fpr", type=float, default=0.005)
    a = p.parse_args(args)
    if a.command == "parse":
        from sieve.operators.mime import parse_message

        print(json.dumps(parse_message(Path(a.file).read_bytes()), ensure_ascii=False, indent=2))
        return 0
    from sieve.session import session

    spark = session()
    if a.command == "evaluate":
        from sieve.plans.evaluation import report

        print("\n".join(report(spark.read.parquet(a.scores), a.fpr)))
        return 0
    from pyspark.sql import functions as F

    from sieve.sources.readers import load_weights, single_message

    settings, weights, fingerprints = load_weights(spark, a.model)
    if a.command == "model-info":
        print(json.dumps(settings | {"weights": weights.count(), "fingerprints": fingerprints.count()}, indent=2))
        return 0
    from sieve.operators.mime import parse_udf
    from sieve.plans.scoring import ScoringConfig, score

    one = single_message(spark, Path(a.file).read_bytes()).select(F.lit(0).alias("msg_id"), parse_udf("raw").alias("m")).select("msg_id", "m.*")
    config = ScoringConfig(settings.get("dimension", 1 << 17), settings["spam_threshold"], settings["ham_threshold"])
    print(score(one, weights, settings["bias"], config).toJSON().first())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
