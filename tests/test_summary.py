"""Folded graphs of trees against a plain walk."""

import random

from pyspark.sql import functions as F

from threadloom.operators import lineage


def walked(nodes):
    """What is drawn of one tree, by a walk from its root; nodes is {node: (parent, abandoned, kept)}."""
    below = {n: sorted(m for m, (p, _, _) in nodes.items() if p == n) for n in nodes}
    root = min(n for n, (p, _, _) in nodes.items() if p is None)
    live = lambda n: [m for m in below[n] if not nodes[m][1]]
    size = lambda n: 1 + sum(map(size, below[n]))
    kept = lambda n: n == root or nodes[n][2]
    out, todo = set(), [(root, None, None)]

    def dropped(n, above, what):
        off = sum(size(m) for m in below[n] if nodes[m][1])
        if off:
            out.add(("abandoned", n, above, what, off))

    while todo:
        node, above, what = todo.pop()
        out.add(("node", node, above, what, 1))
        dropped(node, node, "node")
        for child in live(node):
            if kept(child):
                todo.append((child, node, "node"))
                continue
            run, at = [], child
            while at is not None:
                run.append(at)
                dropped(at, child, "steps")
                more = live(at)
                first = next((m for m in more if kept(m)), None)
                if first is not None:
                    todo.append((first, child, "steps"))
                at = more[0] if first is None and len(more) == 1 else None
            out.add(("steps", child, node, "node", len(run)))
    return out


def drawn(spark, trees):
    rows = [(t, n, p, "abandoned" if off else "accepted", kept) for t, nodes in trees.items() for n, (p, off, kept) in nodes.items()]
    found = lineage.summary(spark.createDataFrame(rows, "tree int, node long, parent long, status string, kept boolean")).collect()
    return {t: {tuple(r)[1:] for r in found if r["tree"] == t} for t in trees}


def test_summary_equals_a_walk(spark):
    rng = random.Random(5)
    trees = {t: {n: (None if n == 1 else rng.choice([n - 1, n - 1, rng.randint(1, n - 1)]), rng.random() < 0.12, rng.random() < 0.25) for n in range(1, rng.randint(2, 60))} for t in range(12)}
    trees[50] = {n: (n - 1 if n > 1 else None, False, n == 200) for n in range(1, 401)}
    trees[51] = {1: (None, False, False), 2: (None, False, True), 3: (2, False, True), 4: (1, True, None), 5: (4, False, True)}
    assert drawn(spark, trees) == {t: walked(nodes) for t, nodes in trees.items()}


def test_nothing_gives_nothing(spark):
    assert lineage.summary(spark.createDataFrame([], "tree int, node long, parent long, status string, kept boolean")).count() == 0


def test_nodes_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        seen.add(1)
        return n

    rows = [(1, n, n - 1 if n > 1 else None, "accepted", n % 5 == 0) for n in range(1, 101)]
    nodes = spark.createDataFrame(rows, "tree int, node long, parent long, status string, kept boolean")
    assert lineage.summary(nodes.withColumn("node", counted("node"))).count() > 0
    assert seen.value == 100
