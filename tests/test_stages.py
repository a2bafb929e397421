"""Staged tables: owned, freed with their owner, and derived anew when their inputs change."""

import os
import shutil
import tempfile

import pyarrow.parquet as pq
import pytest
from conftest import SF_SMALL
from probitas.plans.inputs import Inputs
from probitas.plans.registry import QUERIES, load_all
from probitas.session import checkpoint_root, materialize
from probitas.stages import Owner, fingerprint, owned, release


def stage_folders(spark):
    root = f"{checkpoint_root(spark)}/stages"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_tables_are_freed_with_their_owner_and_no_others(spark):
    before = stage_folders(spark)
    with Owner(spark, "a") as a:
        x = materialize(spark.range(5), "x")
        with Owner(spark, "b") as b:
            y = materialize(spark.range(6), "y")
        z = materialize(spark.range(7), "z")
    kept = materialize(spark.range(8), "nobody's")
    assert (len(a.paths), len(b.paths)) == (2, 1)
    assert a.reads(x) and a.reads(z.where("id > 1")) and not a.reads(y) and not a.reads(kept)
    a.release()
    a.release()  # nothing left to do
    assert y.count() == 6 and kept.count() == 8
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        x.count()
    b.release()
    assert len(stage_folders(spark) - before) == 1


def test_a_query_owns_what_it_stages(spark):
    before = stage_folders(spark)

    @owned
    def doubled(s, n):
        """Twice the rows."""
        df = materialize(s.range(n), "half")
        return df.unionByName(df)

    first, second = doubled(spark, 3), doubled(spark, 4)
    release(first)
    assert second.count() == 8 and doubled.__doc__ == "Twice the rows."
    release(second)
    release(spark.range(1))  # nobody's
    assert stage_folders(spark) == before

    @owned
    def broken(s):
        materialize(s.range(3), "left-behind")
        raise ValueError("no result")

    with pytest.raises(ValueError):
        broken(spark)
    assert stage_folders(spark) == before


def test_nothing_is_left_of_a_released_query(spark):
    load_all()
    Inputs.of(spark, SF_SMALL).samples  # staged inputs belong to the inputs
    Inputs.of(spark, SF_SMALL).prompts
    before = stage_folders(spark)
    df = QUERIES["incremental_scores"](spark, SF_SMALL)
    other = QUERIES["sample_mean"](spark, SF_SMALL)
    assert df.count() and stage_folders(spark) > before
    release(df)
    assert stage_folders(spark) == before and other.count()


def test_a_change_of_the_inputs_is_seen(spark):
    sf = tempfile.mkdtemp(prefix="probitas-inputs-", dir="/tmp") + "/sf"
    shutil.copytree(SF_SMALL, sf)
    os.chmod(sf, 0o755)
    was = fingerprint(spark, [sf])
    old = Inputs.of(spark, sf)
    n = old.samples.count()
    assert Inputs.of(spark, sf) is old and fingerprint(spark, [sf]) == was
    half = pq.read_table(f"{sf}/events.parquet").slice(0, n // 2)
    os.chmod(f"{sf}/events.parquet", 0o644)
    pq.write_table(half, f"{sf}/events.parquet")
    new = Inputs.of(spark, sf)
    assert new is not old and old.owner.changed() and not new.owner.changed()
    assert new.samples.count() == n // 2 and old.samples.count() == n  # frames made before still have their table
    Inputs.release(spark, sf)
    assert not old.owner.paths and not new.owner.paths
    assert fingerprint(spark, [f"{sf}/none"]) == fingerprint(spark, [])
