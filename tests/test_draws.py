"""Hash draws do not depend on partitioning (executor loss recomputes the same)."""
from pyspark.sql import functions as F

from claimspark.operators.sampling import uniform_sample, with_split


def test_label_and_split_partition_independent(spark, sf_small):
    from claimspark.plans import pipeline as P
    f = P.claims_features_plan(spark, sf_small)
    a = with_split(f.repartition(1)).select("claim_id", "denial_label", "split")
    b = with_split(f.repartition(7)).select("claim_id", "denial_label", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sample_exact_size_and_stable(spark, sf_small):
    from claimspark.plans import pipeline as P
    f = P.claims_features(spark, sf_small)
    s1 = {r.claim_id for r in uniform_sample(f.repartition(3), 200).collect()}
    s2 = {r.claim_id for r in uniform_sample(f.repartition(5), 200).collect()}
    assert len(s1) == 200 and s1 == s2


def test_split_share(spark, sf_small):
    from claimspark.plans import pipeline as P
    share = with_split(P.claims_features(spark, sf_small)).agg(F.avg((F.col("split") == "test").cast("double"))).first()[0]
    assert 0.15 < share < 0.25
