"""Command line: python -m lumatile.cli validate {experiment,manifest,fov,codebook} FILE... | version."""

from __future__ import annotations

import json
import sys

from . import __version__
from .sources.validate import RULES


def main(args: list[str]) -> int:
    if args == ["version"]:
        print(__version__)
        return 0
    if len(args) < 3 or args[0] != "validate" or args[1] not in RULES:
        print(__doc__, file=sys.stderr)
        return 2
    bad = 0
    for name in args[2:]:
        try:
            with open(name, encoding="utf-8") as f:
                problems = RULES[args[1]](json.load(f))
        except ValueError as e:
            problems = [f"not JSON: {e}"]
        print(f"{name}: {'; '.join(problems) or 'ok'}")
        bad += bool(problems)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
