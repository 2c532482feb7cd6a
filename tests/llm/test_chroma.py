import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankspark.llm import chroma, queries


def brute_area(frames, a, b, c, d):
    return frames[a:b, c:d].sum()


def test_integral_image():
    x = np.random.default_rng(1).random((9, 12))
    image = chroma.integral(x)
    assert abs(image[7, 5] - image[2, 5] - image[7, 3] + image[2, 3] - brute_area(x, 2, 7, 3, 5)) < 1e-12


def test_tones_have_their_pitch_class():
    t = np.arange(11025 * 2) / 11025
    for hertz, c in ((440, 0), (880, 0), (523.25, 3)):
        frames = chroma.chroma_frames(np.sin(2 * np.pi * hertz * t), 11025)
        assert len(frames) > 5 and (frames.argmax(1) == c).all()


def test_alignment_finds_the_shift(spark):
    rng = np.random.default_rng(7)
    song = rng.random((120, 12)) ** 3
    noisy = song[37:100] + 0.01 * rng.random((63, 12))
    rows = [(0, noisy), (1, song), (2, rng.random((120, 12)) ** 3), (3, np.tile(rng.random(12), (50, 1))), (4, np.tile(rng.random(12), (50, 1))), (5, song[:3])]
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in rows] + [(6, None), (7, [])], "rec long, frames array<double>")
    prints = chroma.fingerprints(df, "rec", "frames")
    got = [(r.query_id, r.match_id, r.shift) for r in chroma.align(prints, F.col("rec").isin(0, 3)).collect()]
    assert got == [(0, 1, 37)]
    assert {r.rec: len(r.prints) for r in prints.collect()}[5] == 0


def test_query_against_all_offsets(spark, small):
    rows = {r.rec_id: r for r in queries.op9_chroma_fingerprints(spark, small).collect()}
    assert sorted(rows) == list(range(2 * -(-500 // 32)))
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    sounds = {r.rec_id: np.frombuffer(r.audio, "<i2") for r in queries.recordings(vectors).collect()}
    prints = {i: chroma.fingerprint(chroma.chroma_frames(x, queries.RATE, queries.WINDOW, queries.HOP)) for i, x in sounds.items()}
    assert {i: len(x) for i, x in prints.items()} == {i: r.n_prints for i, r in rows.items()}
    for i, r in rows.items():
        want = set()
        for j in prints if i % 50 == 0 else ():
            each = {d: chroma.errors_at(prints[i], prints[j], d) for d in range(-len(prints[i]), len(prints[j]))}
            passed = [d for d in each if each[d][0] >= chroma.OVERLAP and each[d][1] <= chroma.ERRORS]
            if passed and i != j:
                want.add((j, min(passed, key=lambda d: each[d][1])))
        got = {(m.match_id, m.shift) for m in r.matches or ()}
        assert want <= got and r.n_matches == len(got)
    assert rows[0].match_id == 1 and rows[0].bit_errors < 0.1


def test_parts_of_one_recording_and_empty_table(spark):
    rng = np.random.default_rng(8)
    song = chroma.fingerprint(rng.random((90, 12)) ** 3).astype("<u4")
    other = chroma.fingerprint(rng.random((90, 12)) ** 3).astype("<u4")
    rows = [(0, song[10:50]), (1, song), (1, song), (1, other), (2, None), (3, song[:0])]
    df = spark.createDataFrame([(i, None if x is None else x.tobytes()) for i, x in rows], "rec long, prints binary")
    got = [(r.query_id, r.match_id, r.shift, r.overlap) for r in chroma.align(df, F.col("rec") == 0).collect()]
    assert got == [(0, 1, 10, 40)]
    assert chroma.align(df.where("false"), F.col("rec") == 0).collect() == []
    sounds = spark.createDataFrame([(1, None, 5), (2, b"", 5), (3, b"abc", 5)], "id long, audio binary, rec int")
    assert {r.rec: len(r.prints) for r in chroma.audio_fingerprints(sounds, "id", "audio", 4096).collect()} == {1: 0, 2: 0, 3: 0}


def test_recall_against_all_offsets(spark):
    rng = np.random.default_rng(3)
    songs = [chroma.fingerprint(rng.random((80, 12)) ** 3) for _ in range(40)]
    rows, planted = [(i, x) for i, x in enumerate(songs)], {}
    for k, share in enumerate((0.05, 0.1, 0.15, 0.2)):
        for i, x in enumerate(songs):
            at = int(rng.integers(0, len(x) - 24))
            flips = np.packbits(rng.random((24, 32)) < share, axis=1).view("<u4").ravel()
            rows.append((1000 * (k + 1) + i, x[at : at + 24] ^ flips))
            planted[1000 * (k + 1) + i] = i, at
    df = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in rows], "rec long, prints binary")
    got = {(r.query_id, r.match_id, r.shift) for r in chroma.align(df, F.col("rec") >= 1000).collect()}
    found = dict(rows)
    for k in range(1, 5):
        want = set()
        for q, (i, _) in planted.items():
            if q // 1000 == k:
                each = {d: chroma.errors_at(found[q], found[i], d) for d in range(-4, len(found[i]) - 20)}
                want.add((q, i, min((d for d in each if each[d][0] >= chroma.OVERLAP), key=lambda d: each[d][1])))
        assert want == {(q, *p) for q, p in planted.items() if q // 1000 == k}
        assert len(want & got) >= 0.9 * len(want), k


def test_all_offsets_and_held_tones(spark):
    rng = np.random.default_rng(4)
    song, tone = chroma.fingerprint(rng.random((60, 12)) ** 3), np.full(30, 77, np.uint32)
    rows = [(0, song[:20]), (1, np.concatenate([song[:20], song[30:50], song[:20]])), (2, tone), (3, tone)]
    df = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in rows], "rec long, prints binary")
    got = {(r.query_id, r.match_id, r.shift) for r in chroma.align(df, F.col("rec").isin(0, 2)).collect() if r.bit_errors == 0}
    assert got == {(0, 1, 0), (0, 1, 40), (2, 3, 0)}


def test_seeds_are_joined_by_a_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(5)
    songs = [chroma.fingerprint(rng.random((60, 12)) ** 3) for _ in range(60)]
    df = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in [*enumerate(songs), *((100 + i, x[9:45]) for i, x in enumerate(songs))]], "rec long, prints binary")
    monkeypatch.setattr(chroma, "BLOCKS", 2, raising=False)
    found = chroma.align(df, F.col("rec") >= 140)
    assert {(r.query_id, r.match_id, r.shift) for r in found.collect() if r.bit_errors == 0} == {(100 + i, i, 9) for i in range(40, 60)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [seed#" in plan and "BroadcastHashJoin [seed#" not in plan


def test_seeds_that_no_query_has_are_left_out():
    rng = np.random.default_rng(6)
    songs = [chroma.fingerprint(rng.random((60, 12)) ** 3) for _ in range(80)]
    songs = [*songs, *(x[5:30] for x in songs[:8]), np.full(40, 7, np.uint32), np.full(40, 7, np.uint32), songs[0][:0]]
    asked, others = [*range(80, 89)], [*range(80), 89, 90]
    even, (bits, keys) = list(range(20)), chroma.seed_bits(4000)
    samples = chroma._samples(bits, keys)
    all_of = lambda rows: [(int(s), rows[r], int(p)) for seed, row, place in chroma._seeds_of(pa.array([songs[i].tobytes() for i in rows], pa.binary()), even, samples, 0, 1) for s, r, p in zip(seed, row, place, strict=True)]
    known = {s for s, _, _ in all_of(asked)}
    want = {x for x in all_of(others) if x[0] in known}
    for tasks in (1, 200):
        shares, blocks, size = chroma.dealing(9 * 27, keys, tasks)
        assert shares * blocks >= tasks and shares <= keys
        rows = sorted((share, other, i) for share in range(shares) for other, of in enumerate((asked, others)) for i in of)
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([c for c, _, _ in rows], [o for _, o, _ in rows], [i for _, _, i in rows], [i for _, _, i in rows])] + [pa.array([songs[i].tobytes() for _, _, i in rows], pa.binary())], ["cell", "other", "rec", "part", "prints"])
        got = [(r["seed"], r["rec"], r["place"]) for b in chroma._shared_seeds(even, bits, keys, shares, size)([batch]) for r in b.to_pylist()]
        assert len(set(got)) == len(got) and want <= set(got)
        assert len(got) - len(want) < 0.05 * len(all_of(others))


def test_copies_are_aligned_once_and_found_for_each(spark):
    rng = np.random.default_rng(11)
    song = chroma.fingerprint(rng.random((70, 12)) ** 3)
    song = np.concatenate([song, song[:30]])
    other = chroma.fingerprint(rng.random((70, 12)) ** 3)
    rows = [(0, song), (1, song), (50, song), (2, song[8:60]), (3, song[8:60]), (100, other), (4, None), (None, song)]
    df = spark.createDataFrame([(i, None if x is None else x.astype("<u4").tobytes()) for i, x in rows], "rec long, prints binary")
    found = chroma.align(df, F.col("rec") % 50 == 0)
    got = {(r.query_id, r.match_id, r.shift) for r in found.collect()}
    again = len(song) - 30
    want = {(q, m, s) for q in (0, 50) for m in (0, 1, 50) if q != m for s in (0, again, -again)}
    assert {x for x in got if x[1] in (0, 1, 50)} == want
    assert {(q, m) for q, m, _ in got} == {(q, m) for q in (0, 50) for m in (0, 1, 2, 3, 50) if q != m}
    votes = {r.match_id: r.votes for r in found.collect() if r.query_id == 0 and r.shift == 0}
    assert votes[1] == votes[50] >= 60
