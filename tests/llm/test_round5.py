"""Cases of the fourth review: the work of the GIF code tables."""

import sys

import numpy as np
import pytest

from shiftlens.llm import media


def lines_run(work):
    """What work returns, and how many lines of the module it runs."""
    count = 0

    def trace(frame, event, _):
        nonlocal count
        if frame.f_code.co_filename != media.__file__:
            return None
        count += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        out = work()
    finally:
        sys.settrace(before)
    return out, count


def test_codes_are_read_in_bulk():
    """Reading takes no line of Python for each code or sample, writing at most seven for a sample of prose, so that op9_gif_media
    keeps its budget."""
    rng = np.random.default_rng(4)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 300)]
    payload, _ = media.payload(" ".join(words[i] for i in (300 * rng.random(5000) ** 2).astype(int)))
    media.decode(media.encode(payload))
    stored, written = lines_run(lambda: media.encode(payload))
    frames, read = lines_run(lambda: media.decode(stored))
    assert b"".join(f["screen"][: f["box"][3], :, 0].tobytes() for f in frames) == payload
    assert read < len(payload) / 50 and written < 7 * len(payload)


def test_decoder_in_steps_and_with_long_links(monkeypatch):
    """Strings whose samples are linked through many codes, cut at each length, with places looked up a few at a time or all at once."""
    rng = np.random.default_rng(5)
    cases = [(b"\1" * 9000, 2), (bytes([0, 1] * 3000), 2)]
    cases += [(np.repeat(rng.integers(0, most, 900), rng.integers(1, 30, 900)).astype(np.uint8).tobytes(), size) for most, size in ((2, 2), (5, 3), (90, 7), (256, 8))]
    for step in (1, 50, media.STEP):
        monkeypatch.setattr(media, "STEP", step)
        for samples, size in cases:
            stream = media.lzw_encode(samples, size)
            for n in (1, 2, 77, len(samples) - 1, len(samples)):
                assert media.lzw_decode(stream, size, n).tobytes() == samples[:n]
            with pytest.raises(ValueError, match="early"):
                media.lzw_decode(stream, size, len(samples) + 1)


def test_samples_over_a_byte_are_kept():
    """Code sizes over 8 have samples that no palette holds; they are read as samples all the same."""
    codes = np.array([512, 3, 300, 511, 515, 513])
    widths = np.full(len(codes), 10)
    assert media.lzw_decode(media._packed(codes, widths), 9, 5).tolist() == [3, 300, 511, 300, 511]
