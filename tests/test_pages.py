"""The paged service as a stream."""

import os

import pytest

from talkweave.sources import videos


def service(flag, pages=5):
    """A playlist of pages of three ids; the page before the last fails once, when the file `flag` is there."""

    def fetch(endpoint, params):
        if endpoint == "channels":
            return {"items": [{"id": "c", "contentDetails": {"relatedPlaylists": {"uploads": "p"}}}]}
        if endpoint == "videos":
            return {"items": [{"id": v, "snippet": {"title": f"title {v}"}} for v in params["id"].split(",") if v != "v4"]}
        at = int(params.get("pageToken", "t0")[1:])
        if at == pages - 2 and os.path.exists(flag):
            os.remove(flag)
            raise ConnectionError("gone for a moment")
        return {"items": [{"contentDetails": {"videoId": f"v{3 * at + k}"}} for k in range(3)]} | ({"nextPageToken": f"t{at + 1}"} if at < pages - 1 else {})

    return fetch


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    flag = str(tmp_path / "flag")
    open(flag, "w").close()
    fetch, out = service(flag), str(tmp_path / "out")

    def run():
        stream = videos.id_stream(spark, fetch, handle="@c")
        q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="gone for a moment"):
        run()
    before = spark.read.parquet(out).count()
    assert 0 < before < 15
    run()
    run()  # nothing more to come
    got = spark.read.parquet(out).collect()
    assert sorted(r.video_id for r in got) == sorted(f"v{k}" for k in range(15))
    assert {(r.page, r.place) for r in got} == {(p, k) for p in range(5) for k in range(3)}
    titles = videos.described(spark.read.parquet(out).repartition(2), fetch).collect()
    assert {(r.video_id, r.title) for r in titles} == {(f"v{k}", f"title v{k}") for k in range(15) if k != 4}
