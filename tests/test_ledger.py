"""Points already in the ledger are not fitted again; changed inputs are."""

from pyspark.sql import functions as F

from litsieve.plans import ledger as ledgers
from litsieve.plans import sweep
from litsieve.plans.dataset import index
from litsieve.sources.tables import cached_table, fingerprint


def papers(spark, n=50, extra=""):
    rows = [(i, f"{'alpha beta' if i % 3 else 'gamma delta'} word{i % 5} common{extra}", i % 3 > 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, flag boolean")


def test_fits_what_is_missing(spark, tmp_path, monkeypatch):
    asked = []
    real = sweep.curve_metrics
    monkeypatch.setattr(sweep, "curve_metrics", lambda data, curve, model, values, **o: asked.append(list(values)) or real(data, curve, model, values=values, **o))
    ledger = ledgers.ResultLedger(spark, str(tmp_path / "results"))
    assert ledger.table().count() == 0
    data = index(papers(spark))
    first = ledger.evaluate(data, "learning_curve", "NB", values=(0.001, 0.5, 1.0), level=0.95)
    rows = sorted(map(str, first.collect()))
    again = ledger.evaluate(data, "learning_curve", "NB", values=(0.001, 0.5, 1.0), level=0.95)
    assert asked == [[0.001, 0.5, 1.0]] and sorted(map(str, again.collect())) == rows and rows
    assert ledger.rows().filter("variable is null").count() == 1  # the empty prefix
    ledger.evaluate(data, "learning_curve", "NB", values=(0.7, 1.0), level=0.95)
    ledger.evaluate(data, "learning_curve", "NB", values=(1.0,), level=0.9)  # another parameter
    ledger.evaluate(index(papers(spark, extra=" new")), "learning_curve", "NB", values=(1.0,), level=0.95)  # another input
    assert asked[1:] == [[0.7], [1.0], [1.0]]
    assert ledger.rows().select("fingerprint").distinct().count() == 2
    wanted = {(r.variable, r.value) for r in sweep.evaluate(data, "learning_curve", "NB", values=(0.7,), level=0.95).collect()}
    own = ledger.evaluate(data, "learning_curve", "NB", values=(0.7,), level=0.95)
    assert {(r.variable, r.value) for r in own.collect()} == wanted and {r.sparselevel for r in own.collect()} == {0.95}


def test_fingerprint_and_cache(spark, tmp_path):
    one = papers(spark)
    same = one.repartition(7).orderBy(F.desc("doc_id"))
    assert fingerprint(one) == fingerprint(same) != fingerprint(one.unionAll(one))
    assert len({fingerprint(one), fingerprint(one, one), fingerprint(one.limit(0)), fingerprint(papers(spark, extra="!"))}) == 4
    path = str(tmp_path / "cache")
    assert cached_table(one.select("doc_id"), path, [one]).count() == 50
    assert cached_table(one.limit(0).select("doc_id"), path, [same]).count() == 50  # same input: the table that is there
    assert cached_table(papers(spark, 60).select("doc_id"), path, [papers(spark, 60)]).count() == 60
