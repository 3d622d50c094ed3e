"""Command line: ``python -m fragsieve.cli preprocess ...`` and ``... match ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.matcher import Matcher, Preprocessor


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="fragsieve")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("preprocess")
    p.add_argument("-p", "--proteome", required=True)
    p.add_argument("-n", "--proteome_name", default="")
    p.add_argument("-k", "--kmer_size", type=int, required=True)
    p.add_argument("-P", "--preprocessed_files_path", default=".")
    m = commands.add_parser("match")
    m.add_argument("-q", "--query", required=True)
    m.add_argument("-p", "--proteome_file", required=True)
    m.add_argument("-m", "--max_mismatches", type=int, default=0)
    m.add_argument("-i", "--max_indels", type=int, default=0)
    m.add_argument("-k", "--kmer_size", type=int, default=5)
    m.add_argument("-P", "--preprocessed_files_path", default=".")
    m.add_argument("-b", "--best_match", action="store_true")
    m.add_argument("-f", "--output_format", default="csv")
    m.add_argument("-o", "--output_name", default="")
    m.add_argument("-v", "--sequence_version", action="store_false")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("fragsieve").getOrCreate()
    if a.command == "preprocess":
        Preprocessor(spark, a.proteome, a.proteome_name, a.preprocessed_files_path).preprocess(a.kmer_size)
        return
    found = Matcher(spark, a.query, a.proteome_file, a.max_mismatches, a.max_indels, a.kmer_size, a.preprocessed_files_path, a.best_match, a.output_format, a.output_name, a.sequence_version).match()
    if found is not None:
        found.show(truncate=False)


def preprocess() -> None:
    """The installed command ``fragsieve-preprocess``."""
    main(["preprocess", *sys.argv[1:]])


def match() -> None:
    """The installed command ``fragsieve-match``."""
    main(["match", *sys.argv[1:]])


if __name__ == "__main__":
    main()
