import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, media, queries
from plumbline.llm.common import table

HARD = ["", "a" * 3000, "<|endoftext|>x <|endoftext|>", "it's we'll  'd ''s 'S", "  \n\n x \t y\n", "²½Ⅷ ªº नमस्ते ไทย 漢字 😀👍🏽", "İ ß\x1ca\x1db​\x85 \xa0 　z", "x" * 20 + " ՘y", "퟿ \U0010ffff"]
SCHEMA = "doc_id long, text string, token_ids string, n_tokens int, media int, spans int"


def frame(spark):
    rows = [(i, t, "mine", 1, 2, 3) for i, t in enumerate(HARD)] + [(None, None, "mine", 1, 2, 3), (1, HARD[1], "mine", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_code_point_like_the_library():
    reference, ours = Tokenizer.from_file(queries.vocabulary()), bpe.Bpe(queries.vocabulary())
    texts = ["".join(f"a{chr(c)}1 {chr(c)}{chr(c)}" for c in range(k, k + 256) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 256)] + HARD
    for text, want, got in zip(texts, reference.encode_batch(texts, add_special_tokens=False), ours.encode(texts), strict=True):
        assert list(got) == want.ids
        assert ours.decode(got).decode() == reference.decode(want.ids, skip_special_tokens=False) == text


def test_small_word_table_is_refilled(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 5)
    reference, ours = Tokenizer.from_file(queries.vocabulary()), bpe.Bpe(queries.vocabulary())
    for text in ["one two three four", "five six one two <|endoftext|>", "seven eight nine ten eleven twelve"]:
        assert list(ours.encode([text])[0]) == reference.encode(text, add_special_tokens=False).ids


def test_bpe_frames(spark, sf):
    df = frame(spark)
    encoded = bpe.encode(df, queries.vocabulary())
    assert encoded.columns == ["doc_id", "text", "n_tokens", "media", "spans", "token_ids"] and encoded.count() == df.count()
    back = bpe.decode(encoded, queries.vocabulary())
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert bpe.digest(df.limit(0), queries.vocabulary()).count() == 0
    reference = Tokenizer.from_file(queries.vocabulary())
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    for r in queries.op7_bpe(spark, sf).collect():
        ids = reference.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_media_query(spark, sf):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, sf, "documents").collect()}
    seen = {}
    for r in queries.op8_media(spark, sf).collect():
        raw = docs[r["doc_id"]]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(payload) + 44
        assert seen.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_media_edges(spark):
    got = media.digest(media.store(frame(spark))).collect()
    empty = [r for r in got if r["n_bytes"] == 0]
    assert len(got) == len(HARD) + 2 and len(empty) == 2 and {r["payload_bytes"] for r in empty} == {64}
    assert media.store(frame(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        media.samples_of(b"RIFF....JUNK")


def test_audio_features():
    t = np.arange(4000) / media.RATE
    quiet, loud = np.zeros(4000), np.sin(2 * np.pi * 700 * t)
    x = np.concatenate([quiet, loud, quiet]) * 100 + 128
    spans, tensors = media.features(np.round(x).astype(np.uint8).tobytes(), media.RATE)
    assert tensors.shape == (len(spans), media.BINS, media.MELS)
    assert any(abs(a - 0.25) < 0.05 and abs(b - 0.5) < 0.05 for a, b in spans[1:])
    assert np.array_equal(media.tensors_of(media.tensor_bytes(tensors)), tensors)
    sine = np.sin(np.arange(200) / 5).astype(np.float32)
    assert np.abs(media.resample(sine, 1, 2)[10:-10] - np.sin(np.arange(100) * 2 / 5)[10:-10]).max() < 0.02
    assert np.abs(media.resample(sine, 3, 2)[30:-30] - np.sin(np.arange(300) * 2 / 3 / 5)[30:-30]).max() < 0.02
    # the polyphase form equals filtering the zero-stuffed signal
    up, down, taps = 3, 2, media.TAPS
    stuffed = np.zeros(200 * up)
    stuffed[::up] = sine
    h = np.concatenate([media.polyphase_filters(up, down)[:, ::-1].T.ravel()])
    full = np.convolve(stuffed, h)[(taps // 2) * up :][: 200 * up : down]
    assert np.abs(full - media.resample(sine, up, down)).max() < 1e-4


def test_log_mel_against_sums(monkeypatch):
    """Every frame's power by the sum of the transform's definition, every band by its triangle."""
    rate, rng = 10_000, np.random.default_rng(4)
    x = rng.normal(size=900)
    frames = 1 + -(-(900 - media.FRAME) // media.HOP)
    window = [0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1)) for n in range(media.FRAME)]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * k / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    want = np.zeros((frames, media.MELS))
    n = np.arange(media.FRAME)
    for t in range(frames):
        part = np.zeros(media.FRAME)
        own = x[t * media.HOP : t * media.HOP + media.FRAME]
        part[: len(own)] = own
        for m in range(media.MELS):
            for k in range(media.FRAME // 2 + 1):
                f = k * rate / media.FRAME
                weight = max(0, min((f - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - f) / (edges[m + 2] - edges[m + 1])))
                if weight:
                    want[t, m] += weight * abs((part * window * np.exp(-2j * np.pi * k * n / media.FRAME)).sum()) ** 2
    want = np.log(want + 1e-6)
    assert np.abs(media.log_mel(x, rate) - want).max() < 1e-6
    monkeypatch.setattr(media, "BLOCK", 2)
    assert np.abs(media.log_mel(x, rate) - want).max() < 1e-6


def test_segments_against_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(300):
        energy = np.round(rng.normal(0, 2, rng.integers(1, 60)).cumsum() * rng.choice([0.3, 1]), 1)
        floor = sorted(energy)[len(energy) // 10]
        on, begun, want = False, 0, []
        for t, e in enumerate([*energy, -np.inf]):
            if not on and e > floor + media.BEGIN_DB:
                on, begun = True, t
            elif on and e < floor + media.END_DB:
                on = False
                want += [(begun, t)] if t - begun >= media.LEAST_FRAMES else []
        assert media.segments(energy) == want


def test_pooled_means():
    rng = np.random.default_rng(5)
    mel = rng.normal(size=(50, media.MELS))
    for a, b in ((0, 50), (3, 8), (10, 11), (20, 37)):
        for k, row in enumerate(media.pooled(mel, a, b)):
            lo = min(int(a + k * (b - a) / media.BINS), b - 1)
            hi = max(int(np.ceil(a + (k + 1) * (b - a) / media.BINS)), lo + 1)
            assert np.abs(row - mel[lo:hi].mean(axis=0)).max() <= media.STEP / 2 + 1e-6 and not (row / media.STEP % 1).any()


def test_the_query_resamples_by_several_phases():
    assert media.UP > 1 and media.polyphase_filters(media.UP, media.DOWN).shape[0] == media.UP
    x = np.sin(np.arange(4000) / 9)
    out = media.resample(x)
    assert len(out) == 2500 and np.abs(out[20:-20] - np.sin(np.arange(2500) * media.DOWN / media.UP / 9)[20:-20]).max() < 0.02


def test_long_words_go_in_time_linear_to_their_length():
    """Against the library; a run of 400,000 letters takes seconds."""
    import time

    from tokenizers import Tokenizer

    ours, theirs = bpe.Bpe(queries.vocabulary()), Tokenizer.from_file(queries.vocabulary())
    rng = np.random.default_rng(1)
    for word in ("a" * 5001, "ab" * 3000, "".join(rng.choice(list("ACGT"), 20_000)), "".join(rng.choice(list("abcdeéñ"), 7000))):
        ids, where = ours.merge([b"hello", word.encode(), b"world"])
        assert ids[where[1] : where[2]].tolist() == theirs.encode(word, add_special_tokens=False).ids
    began = time.time()
    ours.merge(["".join(rng.choice(list("ACGT"), 400_000)).encode()])
    assert time.time() - began < 15


@pytest.mark.parametrize("key", ["doc_id", "N_TOKENS", "media", "Spans", "n_shingles", "license", "text_"])
def test_keys_of_any_name(spark, key):
    from plumbline.llm import jaccard, licenses, pii

    df = spark.createDataFrame([(1, "a b c d e mail me@x.org"), (2, None), (3, "a b c d e mail me@x.org"), (3, "")], f"{key} long, text string")
    for out in (bpe.digest(df, queries.vocabulary(), key=key), media.digest(media.store(df, key=key), key=key), pii.digest(pii.find(df, key=key), key=key), licenses.scan(df, key=key), jaccard.near_duplicates(df, key=key)):
        assert sorted(r[0] for r in out.collect()) == [1, 2, 3, 3] and len({c.lower() for c in out.columns}) == len(out.columns) and out.columns[0] == key
    assert sorted(r[0] for r in jaccard.keep_first(df, key=key).collect()) == [1, 2]
    clash = df.withColumns({"TOKEN_IDS": F.lit(1), "Decoded": F.lit(2)})
    both = bpe.decode(bpe.encode(clash, queries.vocabulary()), queries.vocabulary())
    assert both.columns == [key, "text", "token_ids", "decoded"] and {r["decoded"] for r in both.collect()} == {"a b c d e mail me@x.org", ""}


def test_equal_rows_give_equal_results(spark):
    from plumbline.llm import licenses, pii

    text = "Released under the MIT License. Mail ann@example.org or +1 555 010 2030 now."
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (4, "word " * 60_000 + text)], "doc_id long, text string")
    for out in (licenses.scan(df), pii.digest(pii.find(df)), media.digest(media.store(df))):
        rows = [tuple(r)[1:] for r in out.orderBy("doc_id").collect()]
        assert rows[0] == rows[1] == rows[2] and len(rows) == 5 and out.limit(0).count() == 0


def test_memory_is_given_back_between_batches():
    import re

    import pyarrow as pa

    from plumbline.llm.common import giving_back

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    seen = []

    @giving_back
    def run(batches):
        for batch in batches:
            parts = [bytes(1000) + bytes([k % 256]) for k in range(100_000)]  # small objects, which the allocator keeps once freed
            kept = parts[::5000]
            del parts
            yield batch
            seen.append((held(), len(kept)))

    before = held()
    assert len(list(run(iter([pa.record_batch([pa.array([1])], names=["a"])] * 2)))) == 2
    assert all(after - before < 60 for after, _ in seen)
