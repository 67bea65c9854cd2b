import json

from terradelta.plans import evaluate
from terradelta.streaming import landing


def test_requests_become_runs(spark, tmp_path):
    paths = evaluate.write_synthetic_pair(spark, str(tmp_path / "in"), 128)
    (tmp_path / "landing").mkdir()
    rows = [{"before": paths["before"], "after": paths["after"], "name": "good"}, {"before": paths["before"], "after": str(tmp_path / "no.tif"), "name": "bad"}, {"name": "half"}]
    (tmp_path / "landing" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):
        q = landing.watch(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
        assert q.awaitTermination(120) and q.exception() is None
    status = lambda name: json.load(open(tmp_path / "out" / name / "provenance.json"))["status"]
    assert (status("good"), status("bad")) == ("ok", "failed_validation")
    assert not (tmp_path / "out" / "half").exists()
