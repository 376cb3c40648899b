from pyspark.sql import functions as F

from attesta.plans import core, intake
from attesta.sources.tables import table

D = "/root/testdata/sf0.001"


def test_evidence_of_pinned_sources_is_kept(spark):
    e, p = table(spark, D, "evidence_items"), table(spark, D, "pinned_sources").select("rec_id")
    both = p.unionByName(table(spark, D, "academic_sources").select("rec_id")).select(F.concat(F.lit("source_"), F.col("rec_id").cast("string")).alias("source_id"))
    items = {r.item_id for r in e.join(both, "source_id").select("item_id").collect()}
    pinned = {r.item_id for r in e.join(p.select(F.concat(F.lit("source_"), F.col("rec_id").cast("string")).alias("source_id")), "source_id").collect()}
    got = core._run_evidence(spark, D).select("item_id", "run_id").collect()
    assert len(got) == len(items) and {r.item_id for r in got} == items and pinned
    assert {r.item_id for r in got if r.run_id == core.PINNED} == pinned
    quoted = [r.item_id for r in core.q_in_source(spark, D).collect()]
    assert len(quoted) == len(items) and set(quoted) == items
    assert {r.item_id for r in intake.i_accepted(spark, D).collect()} & pinned
    assert 0 < core.c_core_claims(spark, D).where(F.col("run_id") == core.PINNED).count() <= 5


def test_every_run_has_the_pinned_sources(spark):
    p = {r.rec_id for r in table(spark, D, "pinned_sources").collect()}
    runs = {r.run_id for r in table(spark, D, "academic_sources").select("run_id").distinct().collect()} | {core.PINNED}
    rows = core._run_sources(spark, D).select("run_id", "source_id", "pos").collect()
    assert {(r.run_id, r.source_id) for r in rows if r.source_id in p} == {(r, i) for r in runs for i in p}
    assert len(rows) == table(spark, D, "academic_sources").count() + len(runs) * len(p) == len({(r.run_id, r.pos) for r in rows})
