import json

import pytest
from pyspark.sql import functions as F

from logloom.plans import target_view
from logloom.plans.stream_queries import segmented


def test_view_is_complete_and_final(spark, sf_dir, tmp_path):
    s = segmented(spark, sf_dir).withColumn("g", F.col("user_id").cast("string")).persist()
    assert tuple(target_view.invariants(s).first()) == (True, True)
    frames = target_view.build(s, "g", "unit", "message", "event_type", sample=40)
    told = json.loads(target_view.write(frames, str(tmp_path / "v")))
    assert len(told) == 7 and told["buffer/records"]["rows"] == s.where("segment = 0").count()
    units = spark.read.parquet(str(tmp_path / "v/evaluation/units.parquet"))
    assert units.where("in_sample").count() == 40
    cal = spark.read.parquet(str(tmp_path / "v/buffer/calibration_units.parquet"))
    assert cal.where("cal_uniform").count() == 40 and cal.where("cal_recent and stratum < 8").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        target_view.write(frames, str(tmp_path / "v"))
