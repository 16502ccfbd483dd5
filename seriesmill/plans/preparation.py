"""Preparations known by their content: found again instead of computed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from seriesmill.config import StudyConfig, TreatmentPolicy
from seriesmill.operators import normalize as N
from seriesmill.operators import quality as Q
from seriesmill.sources import store

TABLES = ("excluded", "issues")


def prepare_once(
    observations: DataFrame,
    study: StudyConfig,
    policy: TreatmentPolicy,
    root: str,
    cutoff: date | None = None,
    fingerprint: str | None = None,
) -> Q.Prepared:
    """The preparation of some observations, kept under the id of their content, study, policy and cutoff.

    One that is kept already is read, nothing is prepared. ``fingerprint`` is that of the normalized source; without it
    one narrow aggregate over the observations makes their digest.
    """
    spark = observations.sparkSession
    content = fingerprint or N.content_digest(observations).first()["digest"]
    key = Q.preparation_key(content, study, policy, cutoff)
    if store.load_preparation(spark, root, key) is None:
        fresh = Q.prepare(observations, study, policy, cutoff)
        store.save_preparation(fresh.values, root, key, excluded=fresh.excluded, issues=fresh.issues)
    values = store.load_preparation(spark, root, key)
    excluded, issues = (store.load_preparation(spark, root, key, name) for name in TABLES)
    return Q.Prepared(values, Q.adjustments_log(values), excluded, key, issues)
