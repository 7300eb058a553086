"""Isolation forests and behaviour models over line items; tests/test_models.py compares them with slow definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orebed.operators import models as M
from orebed.queries.base import query, table


#: What tells line items apart.
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def measures(spark, sf_dir):
    names = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}
    return table(spark, sf_dir, "lineitem").select(*IDS, "l_returnflag", *[F.col(c).cast("double").alias(n) for c, n in names.items()])


@query("isolation_anomalies")
def isolation_anomalies(spark, sf_dir):
    """Isolation scores of all line items, and the hundredth that stands out."""
    return M.isolation_forest(measures(spark, sf_dir), IDS, ["quantity", "price", "discount", "tax"])


@query("behaviour_residuals")
def behaviour_residuals(spark, sf_dir):
    """Prices and quantities against models by return flag, which the even orders fit."""
    return M.behaviour_residuals(measures(spark, sf_dir), "l_orderkey % 2 = 0", "l_returnflag", IDS, ["price", "quantity"], ["price", "quantity", "discount", "tax"])
