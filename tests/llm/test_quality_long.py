"""The upper compression band of very long texts."""

from tidemark.llm import quality


def test_upper_band_rises_with_length():
    bands = quality.Bands()
    assert not bands.outside(2.74, 512 << 10) and not bands.outside(2.61, 256 << 10)  # clean de and fr texts, joined
    assert bands.outside(2.71, 64 << 10) and bands.outside(4.0, 512 << 10) and not bands.outside(2.69, 64 << 10)


def test_a_long_clean_text_is_kept():
    text = "".join(f"{chr(97 + i % 26)}{i * 7919 % 99991} " for i in range(80_000))
    raw = len(text.encode())

    def compress(x):  # whole ratio 2.74, chunks at 2.0
        return bytes(int(len(x) / (2.74 if len(x) == raw else 2.0)))

    assert raw > 512_000 and quality.measure(text, quality.Bands(), compress)[6]
