import pytest

from lacewing import datasets as D
from lacewing.queries import queries

SMALL = "/root/testdata/sf0.001"


def least_labels(edges):
    """By relaxing all edges until nothing changes."""
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if label[a] < label[b]:
                label[b], changed = label[a], True
    return label


@pytest.mark.parametrize(("graph", "make"), [("", D.event_chain), ("_hierarchy", D.hierarchy)])
def test_components_of_whole_graphs(spark, graph, make):
    edges = [tuple(r) for r in make(spark, SMALL).edges.select("src", "dst").collect()]
    directed, weak = least_labels(edges), least_labels(edges + [(b, a) for a, b in edges])
    names = (("cc_directed", directed), ("cc_directed_compressed", directed), ("wcc", weak)) + ((("wcc_compressed", weak),) if not graph else ())
    for name, want in names:
        got = queries()[name + graph](spark, SMALL).select("id", "label").collect()
        assert len(got) == len(want)
        assert {r["id"]: r["label"] for r in got} == want
