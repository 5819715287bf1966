"""Signatures over held objects: verified once each, then joined; rotations and unsigned objects follow from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..sources import ids


@F.pandas_udf(BooleanType())
def _checked(alg: pd.Series, key: pd.Series, signature: pd.Series, purpose: pd.Series, body: pd.Series) -> pd.Series:
    rows = zip(alg, key, signature, purpose, body)
    return pd.Series([None not in (a, k, s, p, b) and ids.verify(a, bytes(k), bytes(s), p, p, bytes(b)) for a, k, s, p, b in rows], dtype=bool)


def verified(sigs: DataFrame, keys: DataFrame, objects: DataFrame) -> DataFrame:
    """sigs(cid, author, target, purpose, value) whose bytes verify under the author's key over the target's bytes."""
    own = keys.select(F.col("cid").alias("author"), "alg", "pubkey")
    body = objects.select(F.col("cid").alias("target"), F.col("bytes").alias("body"))
    met = sigs.dropDuplicates(["author", "target", "purpose", "value"]).join(own, "author").join(body, "target")
    return met.filter(_checked("alg", "pubkey", "value", "purpose", "body")).select(*sigs.columns)


def rotations(sigs: DataFrame, keys: DataFrame, objects: DataFrame) -> DataFrame:
    """(old, new): keys whose `rotates` claim both the old and the new key signed for that purpose."""
    good = verified(sigs.filter("purpose = 'rotation'"), keys, objects).select("target", "author").distinct()
    claimed = keys.filter("rotates IS NOT NULL").select(F.col("cid").alias("new"), F.col("rotates").alias("old"))
    by = lambda side: good.select(F.col("target").alias("new"), F.col("author").alias(side))
    signed_by_old = claimed.join(by("old"), ["new", "old"], "left_semi")
    return signed_by_old.join(good.filter("target = author").select(F.col("target").alias("new")), "new", "left_semi").select("old", "new")


def unsigned(objects: DataFrame, sigs: DataFrame, keys: DataFrame, trusted: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Objects without a verified signature by a trusted(key); drafts(cid) are exempt."""
    good = verified(sigs.join(trusted.select(F.col("key").alias("author")), "author", "left_semi"), keys, objects)
    left = objects.join(good.select(F.col("target").alias("cid")).distinct(), "cid", "left_anti")
    return left if drafts is None else left.join(drafts.select("cid").distinct(), "cid", "left_anti")
