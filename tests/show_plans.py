"""Dev tool: write the physical plans of the key queries to PLANS.md.

usage: python tests/show_plans.py [sf_dir]
"""

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from dayspan.session import local_session  # noqa: E402

KEY = ["daily_absence_rate", "overlap_join_bucketed", "curated_spans", "day_matrix", "balance_exact"]
NOTES = {
    "daily_absence_rate": "Contract-days are counted per day in the task that expands them (partial aggregate below the "
                          "exchange). Absences are folded per (worker, division, day) and gathered per month; the narrow "
                          "month pieces of the spans meet one row each. Scans read only the needed columns.",
    "overlap_join_bucketed": "The plan after the stage tables: the pairs (joined on worker, division and month, kept in the "
                             "month where the overlap starts) are one table, the left rows with their own identity "
                             "another; unmatched rows come back through an anti join on that identity.",
    "curated_spans": "The plan after the stage tables (contracts with defaults, spans). Group values (previous end, "
                     "concurrent count, totals) are partial aggregates joined back, not windows.",
    "day_matrix": "Reads the stage-1 tables written to the checkpoint folder. Covered days come back as one map per span; "
                  "the wide rows are expanded to days after that join, with no exchange above; band cuts come from one "
                  "struct scalar subquery over the span table (listed once per reference, run once); the holiday day-set "
                  "is a broadcast bounded by the date domain.",
    "balance_exact": "md5-prefix histograms per (class, bucket) instead of a per-class sort.",
}


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    lines = buf.getvalue().strip().splitlines()
    return "\n".join(l if len(l) <= 180 else l[:177] + "..." for l in lines)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    out = ["# Physical plans of the key queries", "",
           f"Generated by `tests/show_plans.py` on `{sf}` (AQE plans before execution; sizes decide the final "
           "join strategies at run time).", ""]
    for name in KEY:
        out += [f"## {name}", "", NOTES[name], "", "```", plan(E.queries()[name](spark, sf)), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
