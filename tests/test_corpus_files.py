"""A configured pipeline from files: manifests with waves, and archives, to collated batches."""

from __future__ import annotations

import io
import json
import tarfile
import wave

import numpy as np
import pytest

from uttframe.plans.pipeline import DEFAULTS, build_corpus, override


def sound(seconds: float, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((8000 * np.sin(np.arange(int(seconds * rate)) / 5)).astype("<i2").tobytes())
    return out.getvalue()


@pytest.mark.parametrize("kind", ["raw", "shard"])
def test_batches_of_a_corpus(spark, tmp_path, kind):
    length = {f"k{i}": 0.5 + i / 10 for i in range(6)}
    if kind == "raw":
        for k, s in length.items():
            (tmp_path / f"{k}.wav").write_bytes(sound(s))
        lines = [json.dumps({"key": k, "wav": str(tmp_path / f"{k}.wav"), "txt": f"text {k}"}) for k in length]
        lines += [json.dumps({"key": "gone", "wav": str(tmp_path / "none.wav"), "txt": "x"}), "no json"]
        (tmp_path / "list.json").write_text("\n".join(lines))
        path = str(tmp_path / "list.json")
    else:
        path = str(tmp_path / "a.tar")
        with tarfile.open(path, "w") as tar:
            for name, data in [x for k, s in length.items() for x in ((f"{k}.wav", sound(s)), (f"{k}.txt", f"text {k}".encode()))] + [("gone.txt", b"x"), ("bad.wav", b"no wave"), ("bad.txt", b"y")]:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    conf = override(DEFAULTS, "shuffle false", "batch_conf.batch_type static", "batch_conf.n 4", "collate true", "filter false")
    conf["collate_conf"] = {"feats": "feats", "more": ("task", "n_frames")}
    batches, bad = build_corpus(spark, conf, path, kind)
    rows = batches.collect()
    assert sorted(len(r["keys"]) for r in rows) == [2, 4]
    seen = {}
    for r in rows:
        assert r.feat_lengths == r.n_frames == sorted(r.n_frames, reverse=True) and set(r.task) == {"transcribe"}
        assert all(len(f) == r.n_frames[0] and {len(v) for v in f} == {len(r.feats[0][0])} for f in r.feats)
        assert [m.count(False) for m in r["mask"]] == r.feat_lengths
        seen |= dict(zip(r["keys"], r.n_frames, strict=True))
    assert set(seen) == set(length) and all(seen[f"k{i}"] < seen[f"k{i + 1}"] for i in range(5))
    assert {r.key for r in bad.collect()} == ({"gone", None} if kind == "raw" else {"gone", "bad"})
