from gridledger.operators import boards as B
from gridledger.operators import ingest as I
from gridledger.plans import ingest as P


def test_no_stage_holds_very_many_joins(spark, sf_dir):
    """A stage sorts both sides of each of its joins in one task's memory."""
    loaded = I.load(P.board_grid(spark, sf_dir))
    cells, columns, n_rows = (B.kept(x) for x in B.cells_of(loaded))
    plan = B.roles(cells, columns, n_rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 8
