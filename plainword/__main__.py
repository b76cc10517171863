"""python -m plainword batch IN [OUT] | train NAME | bootstrap | clean IN OUT [--setting value ...]"""

from __future__ import annotations

import argparse
import json
import sys

from .plans import config, jobs
from .session import session


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="plainword", description=__doc__)
    p.add_argument("command", choices=["batch", "train", "bootstrap", "clean"])
    p.add_argument("names", nargs="*")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    a = p.parse_args(args)
    try:
        c = config.load(dict((k, _value(v)) for k, _, v in (s.partition("=") for s in a.set)))
        wanted = {"batch": (1, 2), "train": (1, 1), "bootstrap": (0, 0), "clean": (2, 2)}[a.command]
        if not wanted[0] <= len(a.names) <= wanted[1]:
            raise ValueError(f"{a.command} takes {wanted[0]} to {wanted[1]} names")
        if a.command == "train" and a.names[0] not in jobs.TRAININGS:
            raise ValueError(f"no training {a.names[0]!r}")
    except ValueError as e:
        print(e, file=sys.stderr)
        p.print_usage(sys.stderr)
        return 1
    spark = session()
    if a.command == "batch":
        jobs.batch(spark, a.names[0], a.names[1] if len(a.names) > 1 else None, c)
    elif a.command == "train":
        jobs.train(spark, a.names[0], c)
    elif a.command == "bootstrap":
        jobs.bootstrap(spark, c)
    else:
        jobs.clean_job(spark, a.names[0], a.names[1], c)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
