"""No join of op8 sends exploded rows through the driver, which Spark sizes as if they weren't exploded."""

import random

import pytest

from sparkloom.llm import simhash


def broadcast(df):
    """Operators that a plan broadcasts."""
    lines, out, inside = df._jdf.queryExecution().executedPlan().toString().splitlines(), [], None
    for line in lines:
        at = len(line) - len(line.lstrip(" :+-*"))
        inside = None if inside is not None and at <= inside else inside
        if inside is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            inside = at
    return out


@pytest.mark.parametrize("dense", [2, 256])
def test_exploded_rows_are_not_broadcast(spark, dense):
    rnd = random.Random(2)
    centre = rnd.getrandbits(62)
    values = {centre ^ sum(1 << b for b in rnd.sample(range(62), rnd.randint(0, 3))) for _ in range(100)}
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"), 3, dense)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and plan.count("SortMergeJoin") >= (1 if dense > 100 else 2)
    # values that very many fingerprints hold are few
    assert not [x for x in broadcast(links) if "Generate" in x or "point" in x]
