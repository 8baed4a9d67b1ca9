"""The raw load as a stream over a landing folder."""

import shutil

from faultline.sources.contracts import FEED_BY_CORE
from faultline.streaming.raw_feed import start_raw_feed


def test_redelivered_files_load_nothing_new(spark, extract_dir, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    feed = FEED_BY_CORE["incidents"]

    def deliver(name):
        shutil.copy(f"{extract_dir}/{feed.extract_file}", landing / name)
        query = start_raw_feed(spark, str(landing), str(tmp_path / "raw"), str(tmp_path / "state"), feed)
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "raw" / feed.target_table)).count()

    assert deliver("a.json") == 6
    assert deliver("b.json") == 6
