import shutil

import pytest

from tapeglass.plans.feeds import stream_sessions_available_now, stream_sliding_available_now, stream_window_available_now


@pytest.mark.parametrize("query", [stream_window_available_now, stream_sliding_available_now, stream_sessions_available_now])
def test_a_table_in_part_files_gives_the_same(spark, folder, tmp_path, query):
    for kind in ("file", "parts"):
        (tmp_path / kind).mkdir()
        shutil.copy(f"{folder}/events.parquet", tmp_path / kind / "events_old.parquet")  # another table
    shutil.copy(f"{folder}/events.parquet", tmp_path / "file/events.parquet")
    spark.read.parquet(f"{folder}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/parts/events.parquet")
    want, file, parts = (sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in query(spark, str(d)).collect()) for d in (folder, tmp_path / "file", tmp_path / "parts"))
    assert want and want == file == parts
