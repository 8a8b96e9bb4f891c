"""Command line: a subcommand for each pipeline of a catalogue."""

from __future__ import annotations

import argparse
import sys
import time

from tessera.functions.values import integer_list, typed
from tessera.plans.pipeline import Catalogue, PipelineError, run

KINDS = {"IntegerList": integer_list, "bool": lambda x: bool(typed(x)), "int": int, "float": float, "str": str}


def parser(catalogue: Catalogue) -> argparse.ArgumentParser:
    """Global arguments, then those that each pipeline declares."""
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    top.add_argument("volume", help="folder of the volume")
    top.add_argument("-debug", action="store_true", help="print plans")
    commands = top.add_subparsers(dest="pipeline", required=True)
    for name in catalogue.names():
        p = commands.add_parser(name, help=catalogue.pipeline(name).attrib.get("Help"))
        for a in catalogue.arguments(name):
            flag = a.get("flag", f"-{a.get('dest', '')}")
            kind = KINDS.get(a.get("type", "str"), str)
            given = a.get("default")
            p.add_argument(flag, dest=a.get("dest", flag.lstrip("-")), type=kind, required=a.get("required", "").lower() in ("1", "true"), default=kind(given) if given is not None else None, help=a.get("help"))
    return top


def main(argv: list[str] | None = None) -> int:
    """tessera CATALOGUE.xml VOLUME PIPELINE [arguments]: runs it and prints each result's rows."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv:
        print(main.__doc__)
        return 2
    with open(argv[0]) as f:
        catalogue = Catalogue(f.read())
    args = vars(parser(catalogue).parse_args(argv[1:]))
    from pyspark.sql import SparkSession

    from tessera.sources import elements

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    began = time.time()
    name, folder, debug = (args.pop(k) for k in ("pipeline", "volume", "debug"))
    try:
        made = run(catalogue.pipeline(name), elements.load(spark, folder), args)
    except PipelineError as e:
        print(e, file=sys.stderr)
        return 1
    for df in made:
        if debug:
            df.explain("formatted")
        df.show(1000, truncate=False)
    print(f"{name}: {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
