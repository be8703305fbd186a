"""The stored sum tree against a plain loop and a full rebuild."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from regionflow.operators import sum_tree

ROWS, DRAWS = "id BIGINT, td DOUBLE", "draw_id BIGINT, u DOUBLE"


def p(td):
    return (abs(td) + 1e-6) ** 0.6


def plain(prio, draws):
    """draw to slot by a running sum over the slots in order."""
    total, found = sum(prio[k] for k in sorted(prio)), {}
    for d, u in draws:
        acc = 0.0
        for k in sorted(prio):
            acc += prio[k]
            found[d] = k
            if acc >= u * total * (1 - 1e-12):
                break
    return found, total


@pytest.mark.parametrize("fan,pages", [(4, 2), (256, 64)])
def test_rounds_equal_a_loop_and_a_rebuild(spark, table, tmp_path, monkeypatch, fan, pages):
    monkeypatch.setattr(sum_tree, "FAN", fan)
    monkeypatch.setattr(sum_tree, "PAGES", pages)
    draw, path = random.Random(fan), str(tmp_path / "tree")
    tds = {k: draw.uniform(-3, 3) for k in range(0, 300, 2)}
    sum_tree.build(table(list(tds.items()), ROWS), path, 300)
    for n in range(1, 11):
        changes = [(draw.randrange(300), draw.uniform(-9, 9), k) for k in range(12)]
        assert sum_tree.update(spark, path, table([*changes, (changes[0][0], 1.5, 99)], "id BIGINT, td DOUBLE, seq BIGINT")) == n
        tds |= {k: x for k, x, _ in changes} | {changes[0][0]: 1.5}
        if n % 5 == 0:
            draws = [(d, draw.random()) for d in range(40)] + [(40, 0.0), (41, 1.0)]
            got = {r["draw_id"]: r for r in sum_tree.draw(spark, path, table(draws, DRAWS)).collect()}
            want, total = plain({k: p(x) for k, x in tds.items()}, draws)
            assert {d: r["id"] for d, r in got.items()} == want
            assert all(r["weight"] == pytest.approx((len(tds) * p(tds[r["id"]]) / total) ** -0.4) for r in got.values())
            other = str(tmp_path / f"rebuilt{n}")
            sum_tree.build(table(list(tds.items()), ROWS), other, 300)
            again = sum_tree.draw(spark, other, table(draws, DRAWS))
            assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in got.values())


def test_a_round_that_breaks_off_is_passed_over(spark, table, tmp_path):
    path = str(tmp_path / "tree")
    sum_tree.build(table([(k, 1.0) for k in range(1000)], ROWS), path, 1000)
    changes = table([(7, 1e9, 0)], "id BIGINT, td DOUBLE, seq BIGINT")
    assert sum_tree.update(spark, path, changes) == 1
    draws = table([(0, 0.4995)], DRAWS)
    assert sum_tree.draw(spark, path, draws).first()["id"] == 7
    for name in os.listdir(f"{path}/done/round=1"):
        os.remove(f"{path}/done/round=1/{name}")
    assert sum_tree.draw(spark, path, draws).first()["id"] == 499
    assert sum_tree.update(spark, path, table([(900, 1e9, 0)], "id BIGINT, td DOUBLE, seq BIGINT")) == 2
    assert sum_tree.draw(spark, path, draws).first()["id"] == 900


def test_rounds_do_not_read_more_of_a_larger_table(spark, table, tmp_path, monkeypatch):
    """Pages read in a round, on the paths of 5 changes and 20 draws, in tables of 20,000 and 1,000,000 slots."""
    read = []
    plain_read = sum_tree._read

    def counted(*args):
        pages = plain_read(*args)
        read.append(pages.count())
        return pages

    monkeypatch.setattr(sum_tree, "_read", counted)
    rows = []
    for size in (1_100_000, 4_400_000):
        path, draw = str(tmp_path / f"tree{size}"), random.Random(1)
        sum_tree.build(spark.range(size).select("id", (F.col("id") % 7 + 1).cast("double").alias("td")), path, size)
        read.clear()
        sum_tree.update(spark, path, table([(draw.randrange(size), 50.0, k) for k in range(5)], "id BIGINT, td DOUBLE, seq BIGINT"))
        got = sum_tree.draw(spark, path, table([(d, draw.random()) for d in range(20)], DRAWS)).collect()
        assert len(got) == 20 and all(0 <= r["id"] < size for r in got)
        rows.append(sum(read))
    assert rows[1] <= (5 + 20) * 3 * sum_tree.PAGES and rows[1] < 1.3 * rows[0]


def test_slots_that_are_refused(spark, table, tmp_path):
    with pytest.raises(Exception, match="missing or negative"):
        sum_tree.build(table([(None, 1.0)], ROWS), str(tmp_path / "a"), 10)
    sum_tree.build(table([], ROWS), str(tmp_path / "b"), 10)
    draws = table([(0, 0.5)], DRAWS)
    assert sum_tree.draw(spark, str(tmp_path / "b"), draws).count() == 0
    with pytest.raises(Exception, match="beyond the capacity"):
        sum_tree.update(spark, str(tmp_path / "b"), table([(300, 1.0, 0)], "id BIGINT, td DOUBLE, seq BIGINT"))
    none = table([], "id BIGINT, td DOUBLE, seq BIGINT")
    assert sum_tree.update(spark, str(tmp_path / "b"), none) == 0
    sum_tree.update(spark, str(tmp_path / "b"), table([(3, 0.0, 0)], "id BIGINT, td DOUBLE, seq BIGINT"))
    assert sum_tree.draw(spark, str(tmp_path / "b"), draws).first()["id"] == 3
