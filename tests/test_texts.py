"""Texts against the rules that they replace."""

from pyspark.sql import functions as F

from reelmill import plans
from reelmill.functions import text as tx

TEXTS = (None, "", " ", "`", "\"'  '", "\x0b", "A man, walks.", "a `man`  walks", "'a man walks...'", "...", "é", "É.", "to be", "a man rides a red bike now", "a man rides a red bike", "x" * 4, "Kelvin KKK", "kelvin kkk.")


def plain(x):
    return F.rtrim(F.lower(tx.sentence(x)), F.lit("."))


def test_what_texts_say_decides(spark):
    pairs = spark.createDataFrame([(a, b) for a in TEXTS for b in TEXTS], "a string, b string")
    a, b = F.col("a"), F.col("b")
    same = lambda most: (plain(a) == plain(b)) | (tx.agreement(tx.sentence(a), tx.sentence(b)) > most)
    long = F.when(tx.sentence(a) == "", True).when(tx.sentence(b) == "", False).otherwise(same(0.9))
    again = (tx.sentence(a) != "") & (tx.sentence(b) != "") & same(0.85)
    rows = pairs.select("a", "b", long.alias("long"), tx.is_vacuous(a, b).alias("short"), tx.vacuous(tx.said(a), tx.said(b)).alias("said"), again.alias("again"), tx.is_revisit(a, F.array(b)).alias("back"))
    for r in rows.collect():
        assert r.long == r.short == r.said and r.again == r.back, r


def test_documents_are_not_shuffled_as_texts(spark, sf_dir):
    plan = plans.queries()["jaccard_vacuous"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.rindex("tokens")]
    # no expression looks at a text again behind the projections that read it
    assert "Window" in above and "regexp_replace" not in plan
