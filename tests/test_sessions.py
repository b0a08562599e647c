"""Session runs of whole day templates against a plain Python version."""

from collections import defaultdict
from itertools import groupby

from meridia.operators import bars as B
from meridia.plans import registry
from meridia.plans.base import bars

registry.load()


def brute_runs(rows, shortest):
    """rows: (product, trading date, minutes of the day); templates first, then runs."""
    minutes = defaultdict(set)
    for product, day, minute in rows:
        minutes[product, day].add((minute - 1230) % 1440)
    days = defaultdict(list)
    for (product, day), rel in sorted(minutes.items()):
        parts = []
        for m in sorted(rel):
            if parts and m - parts[-1][1] <= 15:
                parts[-1][1] = m
            else:
                parts.append([m, m])
        days[product].append((day, ",".join(f"{lo}-{hi + 1}" for lo, hi in parts)))
    found = set()
    for product, templates in days.items():
        out = []
        for template, run in groupby(templates, key=lambda x: x[1]):
            run = list(run)
            if out and (len(run) < shortest or out[-1][2] == template):
                out[-1][1] = run[-1][0]
            else:
                out.append([run[0][0], run[-1][0], template])
        found |= {(product, *r) for r in out}
    return found


def test_state_sessions_equals_brute_force(spark, sf):
    rows = [(r.product % 5, r.day, r.bob.hour * 60) for r in bars(spark, sf).select("product", "day", "bob").collect()]
    got = registry.QUERIES["state_sessions"](spark, sf)
    assert {tuple(r) for r in got.select("product", "date_start", "date_end", "template").collect()} == brute_runs(rows, 2)
    table = B.session_table(got).collect()
    assert table and all(r.bars > 0 for r in table)
