import hashlib
import io
import wave
import zlib

from quillsieve.llm import media


def test_bytes_survive_storage(make, odd):
    docs = make(odd, ["N_BYTES", "media", "id"])
    got = sorted((r.asDict() for r in media.media_digest(docs).collect()), key=str)
    assert len(got) == len(odd)
    want = []
    for i, text, *_ in odd:
        raw = (text or "").encode()
        pad = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((str(i), len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_media_column_is_wav(make):
    row = media.store_wav(make([(1, "abc" * 100)])).first()
    with wave.open(io.BytesIO(row["media"])) as w:
        assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
        assert w.readframes(w.getnframes()) == b"abc" * 100 + bytes(20)


def test_fingerprint_finds_a_tone_and_is_shift_tolerant():
    import numpy as np

    rng = np.random.default_rng(1)
    x = (128 + 40 * np.sin(np.arange(8000) * 0.7) * (rng.random(8000 // 250).repeat(250) > 0.5)).astype(np.uint8).tobytes()
    n, peaks, pairs = media.fingerprint(x)
    assert n > 20 and peaks and len(pairs)
    shifted = media.fingerprint(bytes([128]) * media.HOP * 4 + x)[2]
    codes, late = ({int(p) & ((1 << 22) - 1) for p in a} for a in (pairs, shifted))
    assert len(codes & late) > 0.5 * len(codes)
    assert not len(media.fingerprint(bytes([9]) * 2048)[2])


def test_empty_table(make):
    assert media.media_digest(make([])).count() == 0
