"""The atlas outlives a session and rebuilds what a changed input reaches, and nothing else."""

import json
import shutil
from pathlib import Path

import pytest

from lociq import store
from lociq.plans import catalogue
from lociq.session import table
from lociq.sources import projection as P

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def graph(spark, tmp_path):
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        shutil.copy(DATA / f"{t}.parquet", tmp_path)
    spark.conf.set("lociq.atlas.dir", f"file://{tmp_path}/atlas")
    store.forget()
    yield str(tmp_path)
    spark.conf.unset("lociq.atlas.dir")
    store.forget()


def versions(path):
    return {p.name.split("-")[0]: json.loads(p.read_text())["path"] for p in (Path(path) / "atlas").glob("*/*.json")}


def touch(spark, path, name):
    """Another file with the same rows."""
    rows = spark.read.parquet(f"{path}/{name}.parquet").toPandas()
    rows.to_parquet(f"{path}/{name}.parquet", compression="gzip")


def test_a_second_session_builds_nothing(spark, graph):
    first = sorted(map(tuple, catalogue._pairs(spark, graph).collect()))
    built = versions(graph)
    assert {"steps", "pairs"} <= set(built)
    store.forget()  # what another application knows

    def never():
        raise AssertionError("built again")

    d = store.stored(spark, graph, "pairs", never, order=("a", "b"))
    assert sorted(map(tuple, d.collect())) == first and versions(graph) == built
    assert all(store.fresh(spark, graph).values())


def test_a_changed_input_rebuilds_what_depends_on_it(spark, graph):
    catalogue._reference(spark, graph), catalogue._pairs(spark, graph), P.reads(spark, graph)
    before = versions(graph)
    touch(spark, graph, "customer")  # names of walks; steps and reads do not read it
    store.forget()
    assert {n for n, good in store.fresh(spark, graph).items() if not good} == {"contigs", "reference"}
    catalogue._reference(spark, graph), catalogue._pairs(spark, graph), P.reads(spark, graph)
    after = versions(graph)
    assert {n for n in before if before[n] != after[n]} == {"contigs", "reference"}
    gone = store.sweep(spark, graph)
    assert {Path(p).name for p in gone} == {Path(before[n]).name for n in ("contigs", "reference")}


def test_settings_are_part_of_the_key(spark, graph):
    make = lambda: table(spark, graph, "nation")
    a, b = (store.stored(spark, graph, "names", make, settings={"k": k}) for k in (1, 2))
    assert a.inputFiles() != b.inputFiles() and a.count() == b.count() == 25


def test_an_unfinished_version_is_not_taken(spark, graph):
    P.reads(spark, graph)
    path = Path(versions(graph)["reads"].removeprefix("file://"))
    (path / "_SUCCESS").unlink()
    store.forget()
    assert store.fresh(spark, graph)["reads"] is False
    assert P.reads(spark, graph).count() > 0 and versions(graph)["reads"] != f"file://{path}"


def test_a_failing_maker_leaves_no_note(spark, graph):
    def fails():
        table(spark, graph, "nation")
        raise ValueError("no")

    with pytest.raises(ValueError):
        store.stored(spark, graph, "broken", fails)
    assert "broken" not in versions(graph) and not store._making


def test_line_files_are_kept(spark, graph):
    make = lambda: table(spark, graph, "nation").selectExpr("n_name AS line")
    a = store.stored_lines(spark, graph, "names", make)
    store.forget()
    assert store.stored_lines(spark, graph, "names", make) == a
    assert spark.read.text(a).count() == 25
