from __future__ import annotations

import time

from tessera.streaming import sinks


def test_metrics_and_debug(spark, tmp_path, capfd):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    metrics = sinks.Metrics(keep=1)
    spark.streams.addListener(metrics)
    try:
        query = sinks.debug(spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")))
        query.processAllAvailable()
        query.stop()
        for _ in range(100):
            if metrics.rows:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(metrics)
    assert len(metrics.rows) == 1 and metrics.rows[0][2] in (0, 10) and metrics.rows[0][3] >= 0
