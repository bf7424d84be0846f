"""Equal knots, grid cells on knots, sums on a rounding edge, chance twins."""

from pyspark.sql import functions as F

from loomlog.operators import curves, transfer


def at(spark, knots, q):
    curve = spark.createDataFrame([("a", i, float(x), float(y), g) for i, (x, y, g) in enumerate(knots)], "well_id string, row_idx long, tvt double, gr double, geology string")
    rows = spark.createDataFrame([("a", float(v)) for v in q], "well_id string, q double")
    return curve, [r.c for r in curves.curve_interp(rows, curve, "q", "c").orderBy("q").collect()]


def test_of_equal_knots_the_first_ends_and_the_last_begins_a_piece(spark):
    knots = [(0, 0, "x"), (1, 10, "x"), (1, 4, "x"), (1, 2, "x"), (2, 6, "x")]
    assert at(spark, knots, [0.5, 1.0, 1.5])[1] == [5.0, 2.0, 4.0]


def test_grid_cells_that_fall_on_a_knot_meet_it(spark):
    curve, _ = at(spark, [(1001.1835, 1, "x"), (1025.5835, 21.63, "x"), (1025.5835, 0, "x"), (1026.5, 5, "x")], [])
    got = {r.cell: r.grid_y for r in curves.curve_grid(curve).collect()}
    assert got[122] == 0.0


def test_first_label_of_equal_knots_goes_by_row(spark):
    curve, _ = at(spark, [(3, 1, "b"), (1, 1, "c"), (1, 1, "a")], [])
    log = spark.createDataFrame([("a", 0, 7.0, 100.0, 200.0, 300.0, None)], "well_id string, row_idx long, z double, pa double, pb double, pc double, tvt_input double")
    got = curves.contact_reconstruction(log, curve, {"a": "pa", "b": "pb", "c": "pc"}, "missing").first()
    assert got.contact_tvt == 1.0 - (7.0 - 300.0)


def test_signature_sums_do_not_depend_on_rounding_errors(spark):
    def log(key, place, values):
        return spark.createDataFrame([(key, float(place), float(place), v) for v in values], "well_id string, x double, y double, gr double")

    a, b = log("a", 0, [0.1] * 25), log("b", 1000, [2.5] + [0.0] * 24)  # 2.5 both, 2.5000000000000004 in doubles
    assert [tuple(r) for r in transfer.candidate_signatures(a, b, 0.4).collect()] == [("a", "b")]


def test_audit_names_each_key_s_own_copy_alone(spark):
    from loomlog.catalog.transfer_queries import gated

    audit = gated(spark, "/root/testdata/sf0.1")[1]
    assert audit.where(F.col("donor") != F.concat("well_id", F.lit("_c"))).count() == 0
    assert audit.count() == 700


def test_a_crowd_of_equal_copies_adds_one_pair_per_key(spark):
    def log(keys, shift):
        return spark.createDataFrame([(k, i, float(i), float(i), 50.0 + i, -1.0, 1000.0 + i + shift, 1000.0 + i + shift if i < 60 else None) for k in keys for i in range(100)],
                                     "well_id string, row_idx long, md double, x double, gr double, z double, tvt double, tvt_input double").withColumn("pred", F.lit(0.0))

    donors = log(["c3", "c1", "c2"], 0.0).unionByName(log(["b1"], 0.01))
    pairs = spark.createDataFrame([(k, d) for k in ("a", "b") for d in ("c3", "c1", "c2", "b1")], "key string, donor string")
    few = transfer.first_of_alike(pairs, donors)
    assert sorted(tuple(r) for r in few.collect()) == [("a", "b1"), ("a", "c1"), ("b", "b1"), ("b", "c1")]
    all_, short = (transfer.gated_transfer(transfer.copied_rows(log(["a", "b"], 0.0), donors, p), "pred")[0].select("well_id", "row_idx", "donor", "new_pred") for p in (pairs, few))
    assert sorted(map(tuple, all_.collect())) == sorted(map(tuple, short.collect()))


def test_log_files_are_read_once(spark, tmp_path):
    from loomlog.sources import files

    for name, md in (("a", [2.0, 1.0]), ("b", [5.0])):
        (tmp_path / f"{name}__horizontal_well.csv").write_text("MD,X,Y,Z,GR,TVT,TVT_input\n" + "".join(f"{m},0,0,0,1,2,3\n" for m in md))
    got = files.scan_logs(spark, str(tmp_path))
    assert sorted((r.well_id, r.md, r.row_idx) for r in got.collect()) == [("a", 1.0, 0), ("a", 2.0, 1), ("b", 5.0, 0)]
    assert "csv" not in got._jdf.queryExecution().executedPlan().toString().lower()  # the numbering reads a written table
