"""What workers remember, and when they forget it."""

import time

import pyarrow as pa

from gridloom.llm import frames, language_id, packing, words


def test_another_operator_clears(monkeypatch):
    words.hashed([b"a", b"b"])
    assert len(words._cache) >= 2
    with frames.memory("packing", packing.forget):
        packing._encoder(packing.TOKENIZER).ids(pa.array(["one Two."]))
    assert not words._cache and packing._encoders
    words.hashed([b"c"])
    assert not packing._encoders and len(words._cache) == 1


def test_idle_workers_forget(monkeypatch):
    monkeypatch.setattr(frames, "FORGET_AFTER", 0.1)
    words.hashed([b"a"])
    for _ in range(50):
        time.sleep(0.1)
        if not words._cache:
            break
    assert not words._cache
    assert words.hashed([b"a"]).tolist() == words.hashed([b"a"]).tolist()


def test_a_small_table_forgets_nothing_that_is_used(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 4)
    encoder = packing.WordIds(packing.tokenizer_path())
    for n in range(30):
        text = f"w{n} The the, w{n % 3}!"
        assert encoder.ids(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.seen) + len(encoder.old) < 40


def test_language_cache_restarts(monkeypatch):
    monkeypatch.setattr(language_id, "CACHE_ENTRIES", 3)
    model = language_id.fit({"a": language_id.Counter({"▁ab": 5}), "b": language_id.Counter({"▁xy": 5})}, {"▁ab": 0, "▁xy": 1})
    scorer = language_id.Scorer(model)
    for _ in range(3):
        assert scorer.predict(pa.array(["ab ab q", "xy r s", None, "12"]))[0] == ["a", "b", "und", "und"]
