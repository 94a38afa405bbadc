"""op8 stores its features as tensors, and takes its digests from what is stored."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyloom.llm import audio, queries


def test_audio_tensors_are_stored(spark, monkeypatch):
    paths = {}
    monkeypatch.setattr(audio, "shared_dir", lambda s, name, own=audio.shared_dir: paths.setdefault(name, own(s, name)))
    d = "/root/testdata/sf0.001"
    long = spark.createDataFrame([(-1, "loud \x01\x02 and still " * 9000 + "m" * 40_000 + "x\x01" * 90_000)], "doc_id long, text string")
    monkeypatch.setattr(queries, "documents", lambda s, sf_dir: s.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(long))
    got = {r.doc_id: r.feature for r in queries.op8_media_columns(spark, d).collect()}
    held = spark.read.parquet(paths["tensors"])
    assert audio.tensor_type(held).shape == [audio.FRAMES, audio.MELS]
    read = pq.read_table(paths["tensors"].removeprefix("file://"))  # any Arrow reader sees the shape
    part = read.schema.field("tensors").type.value_type
    assert part.field("log_mel").type == pa.fixed_shape_tensor(pa.int16(), (audio.FRAMES, audio.MELS))
    whole = read["tensors"].combine_chunks().flatten().field("log_mel").to_numpy_ndarray()
    assert whole.shape == (sum(len(r.tensors) for r in held.collect()), audio.FRAMES, audio.MELS)
    media = {r.doc_id: r.media for r in spark.read.parquet(paths["media"]).collect()}
    rows = held.collect()
    assert sorted(r.doc_id for r in rows) == sorted(got) == sorted(media)
    for r in rows:
        _, want, _ = audio.features(media[r.doc_id])
        stored = np.concatenate([np.array(p.log_mel).reshape(audio.FRAMES, audio.MELS) / audio.UNIT for p in r.tensors])
        mel = stored[: len(want)]
        assert len(r.tensors) == -(-len(want) // audio.FRAMES) and np.abs(mel - want).max() < 0.00501 and (stored[len(want) :] == audio.FLOOR).all()
        on = np.zeros(len(mel), bool)
        for p in r.tensors:
            for x in p.loud:
                assert p.t_start <= x.t_start < x.t_end <= p.t_end
                on[round(x.t_start * 100) : round(x.t_end * 100)] = True
        assert (np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0])))).reshape(-1, 2) == (seg := audio.segments(mel))).all()
        exact = hashlib.sha256(np.rint(mel * 10).astype("<i2").tobytes() + seg.astype("<i8").tobytes()).hexdigest()
        assert got[r.doc_id] == f"{len(mel)}:{len(seg)}:{mel.mean(dtype=np.float64):.1f}:{exact[:32]}"
    assert max(len(r.tensors) for r in rows) > 10
    louder = held.withColumn("tensors", F.transform("tensors", lambda t: t.withField("log_mel", F.transform(t["log_mel"], lambda v: (v + 100).cast("short")))))
    marked = louder.withColumn("tensors", F.col("tensors").cast(held.schema["tensors"].dataType))
    assert not set(got.values()) & {r.feature for r in audio.described(marked).collect()}


def test_features_against_plain_loops():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, s, n) for s, n in ((0.01, 900), (0.5, 1200), (0.02, 700), (0.9, 333))]).astype(np.float32)
    mel, top = audio.log_mel(x), audio.TARGET / 2
    scale = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (scale(top) * k / (audio.MELS + 1) / 2595) - 1) for k in range(audio.MELS + 2)]
    assert len(mel) == 1 + -(-(len(x) - audio.WINDOW) // audio.HOP)
    for k in range(0, len(mel), 7):
        frame = np.zeros(audio.WINDOW)
        part = x[k * audio.HOP : k * audio.HOP + audio.WINDOW]
        frame[: len(part)] = part
        frame *= 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / (audio.WINDOW - 1))
        power = [abs(sum(v * np.exp(-2j * np.pi * b * i / audio.FFT) for i, v in enumerate(frame))) ** 2 for b in range(audio.FFT // 2 + 1)]
        for m in range(0, audio.MELS, 5):
            a, b, c = edges[m : m + 3]
            weight = [max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f in (i * audio.TARGET / audio.FFT for i in range(audio.FFT // 2 + 1))]
            want = max(audio.FLOOR, 10 * np.log10(np.dot(power, weight) + 1e-10))
            assert abs(mel[k, m] - want) < 0.02
    level = mel.mean(axis=1) - np.median(mel.mean(axis=1))
    on, found = False, []
    for i, v in enumerate(level):
        if not on and v >= audio.UPPER:
            on, first = True, i
        elif on and v < audio.LOWER:
            on = False
            found.append([first, i])
    if on:
        found.append([first, len(level)])
    assert found and audio.segments(mel).tolist() == found


def test_a_task_that_runs_again_writes_the_same_file(spark, monkeypatch):
    paths = {}
    monkeypatch.setattr(audio, "shared_dir", lambda s, name, own=audio.shared_dir: paths.setdefault(name, own(s, name)))
    docs = spark.createDataFrame([(i, f"text {i} " * i) for i in range(40)], "doc_id long, text string").repartition(5)
    media = audio.media(docs)
    first = audio.stored_tensors(media).orderBy("doc_id").collect()
    again = audio.stored_tensors(media).orderBy("doc_id").collect()  # over what is there
    assert first == again and len(first) == 40


def test_other_columns_and_no_documents(spark):
    docs = spark.createDataFrame([("a", 1, "x", 2), (None, None, None, None)], "text string, doc_id long, `tensors.log_mel` string, media int")
    got = audio.digests(audio.media(docs))
    assert got.count() == 2 and "n_bytes" in got.columns
    assert audio.digests(audio.media(docs.limit(0))).count() == 0
