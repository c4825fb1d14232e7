from tierline.streaming.jobs import (
    file_stream, stream_to_bronze, windowed_aggregates, dedup_within_watermark,
    upsert_latest_stream, run_until_caught_up,
)

__all__ = ["file_stream", "stream_to_bronze", "windowed_aggregates", "dedup_within_watermark",
           "upsert_latest_stream", "run_until_caught_up"]
