"""The encoder's cache is looked up, not walked through for every batch."""

from quire.llm import packing


class Looked(dict):
    def keys(self):
        raise AssertionError("walks through the cache")


def test_a_batch_does_not_walk_through_the_cache():
    encoder = packing.WordEncoder(packing.tokenizer_file())
    texts = ["Plain words, twice plain.", "数学 and Größe", ""]
    want = encoder(texts)
    encoder.stretches = Looked(encoder.stretches)
    assert encoder(texts) == want and encoder([t + " new" for t in texts]) == packing.WordEncoder(packing.tokenizer_file())([t + " new" for t in texts])
