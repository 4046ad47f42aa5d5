from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lociq.operators.components import connected_components


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=12))
def test_least_node_of_each_component(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
