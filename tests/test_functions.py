from pyspark.sql import functions as F

from tideframe.config import Config
from tideframe.functions import numbers, text


def one(spark, column, **values):
    return spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()}).select(column).first()[0]


def test_timecode(spark):
    for s, want in ((0.0, "00:00:00"), (125.0, "00:02:05"), (3661.0, "01:01:01"), (0.5, "00:00:00"), (1.5, "00:00:02"), (2.5, "00:00:02"), (-3.0, "00:00:00"), (360000.0, "100:00:00")):
        assert one(spark, text.timecode(F.col("s")), s=s) == want


def test_slug(spark):
    for t, want in (("User Detail / Edit!", "user-detail-edit"), ("", "item"), ("?!", "item"), ("  Été_à  vivre ", "été-à-vivre")):
        assert one(spark, text.slugify(F.col("t")), t=t) == want


def test_fraction(spark):
    for t, want in (("30000/1001", 29.97), ("0/0", 0.0), ("abc", 0.0), ("25/1", 25.0)):
        assert one(spark, numbers.parse_fraction(F.col("t")), t=t) == want


def test_paths_and_kinds(spark):
    kind = lambda p: one(spark, text.file_kind(F.col("p")), p=p)
    assert kind("a/B.MP4") == "recording" and kind("n.vtt") == "transcript" and kind("x.xyz") is None
    assert one(spark, text.padded_id("state", F.col("n"), 4), n=12345) == "state_12345"
    assert one(spark, text.frame_number(F.col("p")), p="file:/x/frame_000012.png") == 12


def test_config():
    assert Config.from_dict({"cut_distance": 0.2, "other": 1}).cut_distance == 0.2
    assert Config().with_flags(cut_distance=None, sample_fps=2.0) == Config(sample_fps=2.0)
