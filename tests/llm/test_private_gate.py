"""Candidates that the cheap gates before the broad patterns must let pass."""

from tidemark.llm import private_data


def found(text):
    return [(text[s:e], k) for s, e, k in private_data.candidates(text, private_data.base_spans(text))]


def test_spelt_at_with_a_plain_dot():
    for spelt in ("jane [at] example.com", "jane(at)example.org", "jane[at]mail.example.com"):
        assert found(f"Write to {spelt}, please") == [(spelt, "email")]
        model = private_data.Model({"bias": 1.0})
        assert private_data.mask_text(f"Write to {spelt}, please", model) == "Write to <EMAIL>, please"


def test_long_secrets_are_whole():
    for n in (16, 128, 129, 5000):
        token = ("a1B2" * n)[:n]
        assert found(f"token {token} end") == [(token, "secret")]
