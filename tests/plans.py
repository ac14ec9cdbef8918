"""What the plans of all queries contain, those before each written table too; python tests/plans.py prints the findings."""

import re
import sys
from pathlib import Path

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def initial_plan(df) -> str:
    df._jdf.queryExecution().executedPlan()
    return df._jdf.queryExecution().executedPlan().toString()


def single_task_windows(plan: str) -> list[str]:
    """Windows without a partition key, except the bounded ones over parts and cells."""
    specs = re.findall(r"windowspecdefinition\(([^\n]*?), specifiedwindowframe", plan)
    # without a partition key the definition starts with an ordered column
    keyless = [s for s in specs if re.match(r"\w+#\d+L? (ASC|DESC)", s)]
    return sorted({s.split("#")[0] for s in keyless} - {"_part", "_cell", "part"})


def findings(df) -> list[str]:
    plan = initial_plan(df)
    return [f for f in FORBIDDEN if f in plan] + single_task_windows(plan)


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import queries
    from tracewell import session
    from tracewell.session import build_session

    spark = build_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    for name, fn in queries().items():
        if len(sys.argv) > 1 and not name.startswith(sys.argv[1]):
            continue
        found: list[str] = []
        session.WATCHERS[:] = [lambda df, found=found: found.extend(findings(df))]
        found += findings(fn(spark, "/root/testdata/sf0.001"))
        if found:
            print(name, sorted(set(found)), flush=True)
