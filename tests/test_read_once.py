"""Sides and cells that are read several times are computed once."""

from gridledger.plans import coverage, quality


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_references_read_kept_rows(spark, sf_dir):
    assert "o_orderkey" not in plan(coverage.references(spark, sf_dir)) and "o_orderkey" not in plan(quality.mismatch_warnings(spark, sf_dir))


def test_cells_are_normalised_once(spark, sf_dir):
    assert "l_returnflag" not in plan(quality.structure_warnings(spark, sf_dir))


def test_both_sides_of_an_export_are_kept(spark, sf_dir, monkeypatch):
    made, held, systems, kept = [], [], coverage.systems, coverage.kept
    monkeypatch.setattr(coverage, "systems", lambda *a: made.append(systems(*a)) or made[-1])
    monkeypatch.setattr(coverage, "kept", lambda df: held.append(df) or kept(df))
    coverage.coverage_csv(spark, sf_dir)
    assert len(made) == 1 and any(df is made[0] for df in held)
