"""The verbs: python -m sceneloom scan | parse | types, each with --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from .operators import scanner, statements, token_types
from .sources import scenes, token_json
from .streaming import changes


def scan(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scripts to tokens, as one pretty-printed array; with --watch, tokens that follow the scripts' changes until the program is stopped."""
    if args.watch:
        changes.keep_scanned(spark, args.scripts, args.to, args.semantics).awaitTermination()
        return
    found = scenes.with_own_names(scenes.without_missing(scenes.read_scenes(spark, args.scripts)))
    token_json.write_pretty(scanner.scan(found, args.semantics), args.to)


def parse(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tokens to statements and the outcome of each scene, as Parquet, and the number of tokens of each scene on the screen."""
    tokens = token_json.read_pretty(spark, args.tokens)
    tokens.groupBy("scene_name").agg(F.count(F.lit(1)).alias("n_tokens")).orderBy("scene_name").show(args.show, truncate=False)
    statements.parsed(tokens, args.semantics).write.mode("overwrite").parquet(f"{args.to}/statements")
    statements.parse_outcome(tokens).write.mode("overwrite").parquet(f"{args.to}/outcome")


def types(spark: SparkSession, args: argparse.Namespace) -> None:
    """Declarations that an index file reaches, to the union of their literals. A missing index is an error."""
    read = spark.read.text(args.sources, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ts").select(F.expr("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    roots = [r.path for r in read.filter(F.col("path").endswith(args.index)).select("path").distinct().limit(2).collect()]
    if len(roots) != 1:
        raise SystemExit(f"{args.index} names {'no' if not roots else 'more than one'} file")
    reached = read.join(token_types.reachable_files(read, roots[0]), "path")
    token_types.union_text(token_types.declared_types(reached.filter("depth > 0"))).select("declaration").coalesce(1).write.mode("overwrite").text(args.to)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sceneloom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, source in ((scan, "scripts"), (parse, "tokens"), (types, "sources")):
        own = verbs.add_parser(verb.__name__, help=verb.__doc__)
        own.add_argument(source)
        own.add_argument("to")
        if verb is types:
            own.add_argument("--index", default="/index.ts")
        else:
            own.add_argument("--semantics", choices=("observed", "intended"), default="observed" if verb is scan else "intended")
        if verb is scan:
            own.add_argument("--watch", action="store_true")
        if verb is parse:
            own.add_argument("--show", type=int, default=20)
        own.set_defaults(run=verb)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("sceneloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
