"""Models by MLlib: regimes, risk, calibration and remaining life, whose fitting is distributed and beyond SQL; and retrieval by term weights."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.operators import retrieval as R
from orebed.operators.longseries import settled
from orebed.queries.base import SERIES, query, series, table


def asset_features(spark, sf_dir):
    """Mean, spread and size of each asset's readings."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("spread"), F.count("value").cast("double").alias("n")).where("mean IS NOT NULL")


def assembled(df, inputs, output="x"):
    return VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="skip").transform(df)


@query("operating_regimes")
def operating_regimes(spark, sf_dir):
    """Three regimes of assets by k-means on standardised features."""
    rows = assembled(asset_features(spark, sf_dir), ["mean", "spread", "n"], "raw")
    rows = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(rows).transform(rows)
    return KMeans(k=3, seed=0, featuresCol="x", predictionCol="regime").fit(rows).transform(rows).select("user_id", "regime")


def risk_rows(spark, sf_dir):
    """Text shape of labelled documents, read once: fitting and scoring pass over these rows many times."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.split(F.trim(text), r"\s+")).cast("double")
    digits = F.length(text) - F.length(F.regexp_replace(text, "[0-9]+", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), (F.length(text) / words).alias("per_word"), (digits / F.greatest(F.length(text), F.lit(1))).alias("digits"))
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    return assembled(settled(docs.join(labels, "doc_id")), ["words", "per_word", "digits"])


@query("risk_model")
def risk_model(spark, sf_dir):
    """Logistic regression on text shape, learned on the rows of three of four ids, scored on all."""
    rows = risk_rows(spark, sf_dir)
    model = LogisticRegression(featuresCol="x", regParam=0.01).fit(rows.where("doc_id % 4 <> 0"))
    return model.transform(rows).select("doc_id", "label", F.element_at(vector_to_array("probability"), 2).alias("p"))


@query("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    """The risk model's scores made calibrated by isotonic regression."""
    scored = settled(risk_model(spark, sf_dir))
    model = IsotonicRegression(featuresCol="p", predictionCol="calibrated").fit(scored.where("doc_id % 4 <> 0").select("p", "label"))
    return model.transform(scored).select("doc_id", "p", "calibrated")


@query("remaining_life_model")
def remaining_life_model(spark, sf_dir):
    """Boosted trees from a reading's place, value and recent mean to the readings that still follow in its series, capped at 125; every fourth asset is held out of fitting."""
    w = Window.partitionBy(*SERIES).orderBy("t_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    rows = series(spark, sf_dir).withColumn("recent", F.avg("value").over(w.rowsBetween(-4, 0))).withColumn("remaining", F.least(F.lit(125.0), (n - 1 - F.col("t_idx")).cast("double")))
    rows = assembled(rows.withColumn("held_out", F.col("user_id") % 4 == 0), ["t_idx", "value", "recent"])
    model = GBTRegressor(featuresCol="x", labelCol="remaining", maxIter=5, maxDepth=3, seed=0).fit(rows.where("NOT held_out"))
    return model.transform(rows).select("event_id", "held_out", "remaining", "prediction")


TFIDF_SQL = """tok AS (SELECT {id}, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)) AS term FROM {t} WHERE text IS NOT NULL), tf AS (SELECT {id}, term, count(*) AS tf FROM tok GROUP BY ALL)"""


@query("tfidf_retrieval", f"""WITH d AS (WITH {TFIDF_SQL.format(id='doc_id', t='documents')} SELECT * FROM tf), q AS (WITH {TFIDF_SQL.format(id='item_id', t='benchmark')} SELECT * FROM tf),
df AS (SELECT term, ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM d GROUP BY term),
dn AS (SELECT doc_id, sqrt(sum(tf * tf * idf * idf)) AS norm FROM d JOIN df USING (term) GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(tf * tf * idf * idf)) AS norm FROM q JOIN df USING (term) GROUP BY item_id),
s AS (SELECT item_id, doc_id, sum(d.tf * q.tf * idf * idf) AS dot FROM d JOIN q USING (term) JOIN df USING (term) GROUP BY ALL)
SELECT item_id, doc_id, dot / (dn.norm * qn.norm) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(dot / (dn.norm * qn.norm), 9) DESC, doc_id) AS "rank" FROM s JOIN dn USING (doc_id) JOIN qn USING (item_id) QUALIFY "rank" <= 3""", "score")
def tfidf_retrieval(spark, sf_dir):
    """Each benchmark item's three nearest documents by term weights (smoothed idf) and cosine."""
    return R.tfidf(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), T.simple_tokens, 3)
