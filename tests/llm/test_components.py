"""Connected components against a walk over the links, and what they cost."""

import random

import pytest

from docproof.llm import components as under_test


def walked(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for first in sorted(near):
        todo = [first] if first not in out else []
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = first
                todo += near[x]
    return out


def shapes():
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(300)]
    rng.shuffle(chain)
    hub = [(1000, i) for i in range(1001, 1400)] + [(1000, 7)]
    loose = [(rng.randrange(2000, 2400) * -(10**15), rng.randrange(2000, 2400) * -(10**15)) for _ in range(300)]
    return {"chain": chain, "hub": hub, "loose": loose, "all": [*chain, *hub, *loose, (5, 5), (None, 3), (3, None), *chain[:50]], "none": []}


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("shape", ["chain", "hub", "loose", "all", "none"])
def test_components_are_those_of_a_walk(spark, monkeypatch, shape, parts):
    monkeypatch.setattr(under_test, "HELD", 40)
    links = shapes()[shape]
    got = under_test.components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == walked(links)


def test_links_of_one_task_take_no_round(spark, monkeypatch):
    written, settled = [], under_test.settled
    monkeypatch.setattr(under_test, "settled", lambda df: written.append(1) or settled(df))
    links = shapes()["all"]
    got = under_test.components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect()
    assert {r.node: r.component for r in got} == walked(links)
    assert len(written) == 1
