"""Print the registered queries as a markdown table (name, survey ids,
oracle, what it computes) - the README's query list is generated with it."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoplytics.plans.registry import load_all  # noqa: E402


def main() -> None:
    print("| Query | Survey ids | Oracle | Computes |")
    print("| --- | --- | --- | --- |")
    for name, q in load_all().items():
        doc = " ".join(q.doc.split())
        first = doc.split(". ")[0].rstrip(".")
        oracle = "DuckDB SQL" if q.sql else "sequential model (pytest)"
        print(f"| `{name}` | {', '.join(q.ids)} | {oracle} | {first} |")


if __name__ == "__main__":
    main()
