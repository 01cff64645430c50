"""Print the physical plan of a registered query.

    python -m curbscope.plans.explain <query> [sf_dir] [mode]

``mode`` is any ``DataFrame.explain`` mode (default ``formatted``). Queries
that materialise checkpoints run those jobs while their plan is built.
"""

from __future__ import annotations

import sys

from curbscope.plans.registry import QUERIES
from curbscope.session import ensure_checkpoint_dir, get_spark


def main(argv: list[str]) -> int:
    if len(argv) < 2 or argv[1] not in QUERIES:
        print("usage: python -m curbscope.plans.explain <query> [sf_dir] [mode]")
        print("queries:", ", ".join(sorted(QUERIES)))
        return 2
    name = argv[1]
    sf_dir = argv[2] if len(argv) > 2 else "/root/testdata/sf0.01"
    mode = argv[3] if len(argv) > 3 else "formatted"
    spark = get_spark()
    ensure_checkpoint_dir(spark)
    QUERIES[name](spark, sf_dir).explain(mode)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
