"""Values of a donor are looked up together, with the results of each apart."""

import random

from loomlog.operators import curves, transfer


def frames(spark):
    rng = random.Random(3)
    rows = [("a", i, rng.choice([float(rng.randrange(40)), rng.uniform(-3, 45)]) if i % 17 else None) for i in range(150)] + [("b", 0, 1.0)]
    donor = [("d", i, float(rng.randrange(40)) if i % 11 else None, rng.uniform(0, 9) if i % 4 else None, rng.uniform(0, 9) if i < 1 else None, rng.uniform(0, 9)) for i in range(60)]
    log = spark.createDataFrame(rows, "well_id string, row_idx long, md double")
    return log, spark.createDataFrame(donor, "well_id string, row_idx long, md double, tvt double, gr double, z double")


def test_each_value_is_that_of_its_own_look_up(spark):
    log, donor = frames(spark)
    donor = donor.selectExpr("'a' AS well_id", "row_idx", "md", "tvt", "gr", "z")
    got = curves.asof_transfer_all(log, donor, ["tvt", "gr", "z"])
    want = log
    for c in ("tvt", "gr", "z"):
        want = curves.asof_transfer_md(want, donor, c, out=f"copy_{c}")
    assert got.columns == want.columns and got.count() == 151
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_rows_are_written_once_for_all_values(spark, monkeypatch):
    log, donor = frames(spark)
    written = []
    real = curves.staged
    monkeypatch.setattr(curves, "staged", lambda df: written.append(df.columns) or real(df))
    pairs = spark.createDataFrame([("a", "d")], "key string, donor string")
    got = transfer.copied_rows(log, donor, pairs)
    assert len(written) == 1 and got.where("copy_tvt IS NOT NULL").count() > 50
