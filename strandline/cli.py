"""Command line: scramble gradients, reversal sensitivity, joint reports and factorials over files.

    python -m strandline.cli report --embeddings-a a.parquet --embeddings-b b.parquet --pairs pairs.csv --similarity dtw
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from strandline.operators import diagnostics as G
from strandline.operators.comparators import comparator
from strandline.session import local_session
from strandline.sources.readers import read_pairs, read_sequences


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="strandline", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)

    table = "Parquet of (seq_id, emb)"

    def command(name: str, *, pairs: bool) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        if pairs:
            p.add_argument("--pairs", required=True, help="text lines: id_a,id_b,label")
        p.add_argument("--output", help="file for the JSON; standard output by default")
        return p

    for name in ("scramble-gradient", "report"):
        p = command(name, pairs=True)
        p.add_argument("--embeddings-a", "--first", dest="first", required=True, help=table)
        p.add_argument("--embeddings-b", "--second", dest="second", help=table + "; the first again by default")
        p.add_argument("--similarity", default="cosine")
        p.add_argument("--k-values", type=int, nargs="+", default=[1, 4, 16])
        p.add_argument("--seed", type=int, default=0)
    p = command("s-rev", pairs=False)
    p.add_argument("--embeddings", "--first", dest="first", required=True, help=table)
    p.add_argument("--similarity", default="cosine")
    p = command("decompose", pairs=True)
    p.add_argument("--baseline-embeddings", "--first", dest="first", required=True, help=table)
    p.add_argument("--alternative-embeddings", "--second", dest="second", help=table + "; the baseline's again by default")
    p.add_argument("--baseline-comparator", "--baseline", dest="baseline", default="cosine")
    p.add_argument("--alternative-comparator", "--alternative", dest="alternative", default="dtw")
    return parser


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r) for r in df.toJSON().collect()]


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The result of one command as plain data."""
    first = read_sequences(spark, args.first)
    if args.command == "s-rev":
        comparator(args.similarity)
        found = G.reversal_summary(first, "seq_id", "emb", [args.similarity]).first()
        return {"mean": found["mean"], "std": found["std"], "n_videos": found["n"]}
    second = read_sequences(spark, args.second) if args.second else first
    pairs = read_pairs(spark, args.pairs)
    if args.command == "decompose":
        methods = list(dict.fromkeys([args.baseline, args.alternative]))
        for m in methods:
            comparator(m)
        sets = {"baseline": first, "alternative": second}
        cells = _rows(G.factorial_ap(pairs, sets, methods))
        if not cells:
            raise ValueError("no pairs are shared by all feature sets")
        return {"n_pairs": cells[0]["n_pairs"], "ap": {f: {c["method"]: c["ap"] for c in cells if c["feature"] == f} for f in sets}}
    comparator(args.similarity)
    if args.command == "report":
        return {"report": _rows(G.temporal_report(pairs, first, second, args.k_values, args.similarity, args.seed))}
    gradient = G.scramble_gradient(G.scramble_scores(pairs, first, second, args.k_values, [args.similarity], args.seed)).cache()
    verdict = _rows(G.gradient_verdict(gradient))
    return {"ap": {str(r["k"]): r["ap"] for r in gradient.orderBy("k").collect()}, **(verdict[0] if verdict else {"verdict": "inconclusive"})}


def main(argv: Sequence[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = local_session("strandline-cli")
    spark.sparkContext.setLogLevel("ERROR")
    text = json.dumps(run(spark, args), indent=2)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())

