"""Print a compact physical-plan report per query.

Usage: python tools/plan_report.py [sf_dir] [key ...] [--full]

For each query: number of shuffles (Exchange), broadcast exchanges, sorts,
window operators, Python (Arrow) evaluations, and each scan's pushed
filters / read schema.  ``--full`` prints the formatted plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tierline.plans import all_queries  # noqa: E402
from tierline.session import build_session  # noqa: E402


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def report(name: str, df, full: bool) -> None:
    txt = plan_text(df)
    n_ex = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", txt))
    n_bx = txt.count("BroadcastExchange")
    n_win = txt.count("Window [")
    n_py = len(re.findall(r"(ArrowEvalPython|FlatMapGroupsInArrow|FlatMapGroupsInPandas|MapInArrow|BatchEvalPython)", txt))
    single = "SinglePartition" in txt
    print(f"== {name}: shuffles={n_ex} broadcasts={n_bx} windows={n_win} python={n_py}"
          f"{' SINGLE-PARTITION' if single else ''}")
    for m in re.finditer(r"FileScan (\w+) [^\n]*?PushedFilters: (\[[^\]]*\])[^\n]*?ReadSchema: (struct<[^\n]*>)", txt):
        print(f"   scan {m.group(1)} pushed={m.group(2)[:160]} schema={m.group(3)[:160]}")
    if full:
        print(txt)


def main():
    args = [a for a in sys.argv[1:] if a != "--full"]
    full = "--full" in sys.argv
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    spark = build_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan for inspection
    qs = all_queries()
    for k in keys or list(qs):
        try:
            report(k, qs[k](spark, sf), full)
        except Exception as e:  # noqa: BLE001
            print(f"== {k}: ERROR {type(e).__name__}: {str(e)[:200]}")


if __name__ == "__main__":
    main()
