import pytest
from pyspark.sql import functions as F

from edspark.operators import features as feat
from edspark.plans import catalog


class Seen(Exception):
    pass


def test_every_code_has_a_slot_of_its_own_in_the_classifier(spark, monkeypatch):
    def fit(train, *args, **kwargs):
        raise Seen(train)

    monkeypatch.setattr(feat, "fit_stacked_classifier", fit)
    with pytest.raises(Seen) as seen:
        catalog.q_acuity_classifier(spark, "/root/testdata/sf0.001")
    train = seen.value.args[0]
    codes = train.select(F.explode("__codes").alias("code")).distinct().count()
    assert codes > 128 and train.select("codes_tf").first()["codes_tf"].size == codes
