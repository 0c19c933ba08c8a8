"""Print the formatted physical plan of selected registered queries (plan review aid).

usage: python scripts/explain_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from metricspark.plans import queries as Q  # noqa: E402
from metricspark.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    for name in args:
        print(f"===== {name}")
        Q.QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
